"""op10_licenses: the keywords of a rule let through every wording that its regex has."""

import re
from itertools import product

import pytest

from lineweave.llm import licenses


def _wordings(parsed):
    """Every text of a parsed regex; a repeat is taken as often as its least and its least plus one, a class by each member of a small set."""
    some = []
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            some.append([chr(arg)])
        elif kind == "IN":
            some.append([chr(c) for o, v in arg if str(o) in ("LITERAL", "RANGE") for c in ([v] if str(o) == "LITERAL" else v)] or ["x"])
        elif kind == "SUBPATTERN":
            some.append(_wordings(arg[3]))
        elif kind == "BRANCH":
            some.append([w for p in arg[1] for w in _wordings(p)])
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            one = _wordings(inner)
            some.append([w for n in {low, min(low + 1, high)} for w in map("".join, product(one, repeat=n))])
        else:
            raise AssertionError(kind)
    return list(map("".join, product(*some)))


@pytest.mark.parametrize("label, keywords, regex", [(x, k, n) for x, k, n, _ in licenses.NAMES] + list(licenses.PASSAGES))
def test_every_wording_passes_its_gate(label, keywords, regex):
    stopped = [w for w in _wordings(re._parser.parse(regex)) if not any(f" {k} " in f" {' '.join(w.split())} " for k in keywords.split("|"))]
    assert not stopped, stopped[:20]


@pytest.mark.parametrize("text, label", [
    ("under the Berkeley Software Distribution License", "bsd"), ("under the FreeBSD license", "bsd-2-clause"), ("under the Internet Systems Consortium License", "isc"),
    ("under the PSF License", "psf-2"), ("under the PNG Reference Library License", "libpng"), ("under the AGPLv3", "agpl-3"), ("under the LGPLv3", "lgpl-3"),
    ("under the LGPLv2.1", "lgpl-2.1"), ("under the LGPLv2", "lgpl-2"), ("under the EPL2", "epl-2"), ("under the MPL2", "mpl-2"),
])
def test_labels(text, label):
    assert licenses.scan(text.encode())[5] == label
