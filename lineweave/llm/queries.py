"""The queries of this subpackage's operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from .ann import op3_ann
from .langid import op2_langid
from .licenses import op10_licenses
from .maxent import op8_maxent
from .mixing import op4_mixing
from .pieces import op1_pieces
from .simhash import op9_simhash
from .syncmers import op6_syncmers
from .toxicity import op7_toxicity
from .warc import OP5_SQL, op5_warc

QUERIES = {f.__name__: f for f in (op1_pieces, op2_langid, op3_ann, op4_mixing, op5_warc, op6_syncmers, op7_toxicity, op8_maxent, op9_simhash, op10_licenses)}
ORACLES: dict[str, str] = {"op5_warc": OP5_SQL}
