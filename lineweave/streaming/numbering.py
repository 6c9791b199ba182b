"""A stream of lines: the numbered list of each document as state, line by line."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.numbering import NumberedList, candidates
from ..operators.fold import importable

OUT = "doc_id long, pos int, state int"


def _stacked(value: str) -> NumberedList:
    return NumberedList([(tuple(n), v) for n, v in json.loads(value)])


def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Push the new lines of a document, in order, on the list that its earlier lines left."""
    listing = _stacked(state.get[0]) if state.exists else NumberedList()
    lines = pd.concat(list(parts)).sort_values("pos")
    rows = []
    for pos, found in zip(lines["pos"], lines["found"], strict=True):
        given = [(x["kind"], x["num"], x["bullet"]) for x in json.loads(found)]
        rows.append((key[0], int(pos), listing.push(given)[0]))
    state.update((json.dumps(listing.stack),))
    yield pd.DataFrame(rows, columns=["doc_id", "pos", "state"])


def numbered_list_stream(lines: DataFrame, language: str = "en") -> DataFrame:
    """A stream of (doc_id long, pos, text) -> (doc_id, pos, state), equal to the batch form if lines come in order.

    State is a document's stack of numbers, a few dozen bytes; it lives as long as the query.
    """
    importable(lines.sparkSession)
    found = lines.withColumn("candidates", candidates("text", language))
    given = F.to_json(F.transform("candidates", lambda c: F.struct(c["kind"].alias("kind"), c["num"].alias("num"), c["bullet"].alias("bullet"))), {"ignoreNullFields": "false"})
    return found.select("doc_id", "pos", given.alias("found")).groupBy("doc_id").applyInPandasWithState(step, OUT, "stack string", "append", GroupStateTimeout.NoTimeout)
