"""Features of each line in its context, and of pairs of lines that a pointer may join.

An extractor is a class whose decorated methods give Columns. A line is seen with its neighbours: block 1 the one before,
2 itself, 3 and 4 the ones after. `single` and `pairwise` apply a method to some of them and name the results by them.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbering as N
from ..functions import text as X
from ..operators.fold import importable
from ..operators.layout import CELL_THRESH, LEFT_THRESH, belongs, cell_constants, clusters, index_of, mean, page_constants, similar_lines, text_constants
from ..operators.structure import DOWN, ELIMINATE, SAME_LEVEL, UP


class Block:
    """A neighbour: its fields as Columns; `there` whether it exists."""

    def __init__(self, name: str) -> None:
        self._name = name

    def __getattr__(self, field: str) -> Column:
        if field == "there":
            return F.col(f"{self._name}.pos").isNotNull()
        return F.col(f"{self._name}.{field}")

    def path(self, field: str) -> str:
        return f"{self._name}.{field}"


def _named(name: str) -> str:
    if "-" in name:
        raise ValueError(f"a feature's name may not have '-': {name}")
    return name


def feature(name: str | None = None) -> Callable:
    """A method of all four neighbours."""

    def mark(f: Callable) -> Callable:
        f.spec = ("raw", _named(name or f.__name__), None)
        return f

    return mark


def single(targets: list[int], name: str | None = None) -> Callable:
    """A method of one neighbour, applied to each of `targets` (0 to 3)."""
    if not targets or len(set(targets)) != len(targets) or not set(targets) <= {0, 1, 2, 3}:
        raise ValueError(f"targets must be some of 0 to 3, each once: {targets}")

    def mark(f: Callable) -> Callable:
        f.spec = ("single", _named(name or f.__name__), targets)
        return f

    return mark


def pairwise(pairs: list[tuple[int, int]], name: str | None = None) -> Callable:
    """A method of two neighbours, applied to each of `pairs`."""
    if not pairs or len(set(pairs)) != len(pairs) or any(len(p) != 2 or not set(p) <= {0, 1, 2, 3} for p in pairs):
        raise ValueError(f"pairs must be of 0 to 3, each once: {pairs}")

    def mark(f: Callable) -> Callable:
        f.spec = ("pairwise", _named(name or f.__name__), pairs)
        return f

    return mark


def pointer(name: str | None = None) -> Callable:
    """A method of (head, target line, pointing line, the line after it)."""

    def mark(f: Callable) -> Callable:
        own = _named(name or f.__name__)
        if own == "transition":
            raise ValueError("the name `transition` is taken")
        f.spec = ("pointer", own, None)
        return f

    return mark


def _flat(name: str, made: object, suffix: str = "", index: int | None = None) -> dict[str, Column]:
    """Columns of a result: one, or several of a list or dict. Those of a single neighbour bear its index, a lone one the index plus one."""
    if isinstance(made, dict):
        return {f"{name}{'' if index is None else f'_{index}'}{suffix}_{k}": made[k] for k in sorted(made)}
    if isinstance(made, list | tuple):
        return {f"{name}{'' if index is None else f'_{index}'}{suffix}_{k}": c for k, c in enumerate(made)}
    return {f"{name}{'' if index is None else f'_{index + 1}'}{suffix}": made}


class Extractor:
    """Base of extractors: which columns a block has, what is known of a document, and the features."""

    columns: tuple[str, ...] = ()
    language = "en"

    def __init_subclass__(cls, **kw: object) -> None:
        super().__init_subclass__(**kw)
        seen: dict[str, str] = {}
        for base in reversed(cls.__mro__):
            for attr, f in vars(base).items():
                if spec := getattr(f, "spec", None):
                    if seen.get(spec[1], attr) != attr:
                        raise TypeError(f"two features are called {spec[1]}")
                    seen[spec[1]] = attr

    def _specs(self, *kinds: str) -> list[tuple[str, str, object, Callable]]:
        found = {a: getattr(self, a) for c in reversed(type(self).__mro__) for a, f in vars(c).items() if hasattr(f, "spec")}
        return [(*f.spec, f) for f in found.values() if f is not None and f.spec[0] in kinds]

    def prepared(self, blocks: DataFrame) -> DataFrame:
        """Blocks with the columns that features look at besides their own."""
        return blocks

    def constants(self, blocks: DataFrame) -> DataFrame | None:
        """A row for each document, or none."""
        return None

    def line_columns(self) -> dict[str, Column]:
        b = [Block(f"b{k}") for k in range(1, 5)]
        out: dict[str, Column] = {}
        for kind, name, where, f in self._specs("raw", "single", "pairwise"):
            if kind == "raw":
                out |= _flat(name, f(*b))
            elif kind == "single":
                for t in where:
                    out |= _flat(name, f(b[t]), index=t)
            else:
                for p, q in where:
                    out |= _flat(name, f(b[p], b[q]), suffix=f"_{p + 1}_{q + 1}")
        return {k: c.cast("double") for k, c in out.items()}

    def pointer_columns(self) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for _, name, _, f in self._specs("pointer"):
            out |= _flat(name, f(Block("head"), Block("t1"), Block("t2"), Block("t3")))
        return {k: c.cast("double") for k, c in out.items()}


def neighbours(blocks: DataFrame, columns: list[str], labels: str | None = None) -> DataFrame:
    """(doc_id, pos, b1 .. b4). With labels, block 3 of a line that is not ELIMINATE is the next one that is not, and 4 the one right after it.

    All windows are over a document's lines in one order or its reverse: one exchange serves them.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    own = F.struct("pos", *columns)
    if labels is None:
        return blocks.select("*", own.alias("b2")).select("*", F.lag("b2").over(w).alias("b1"), F.lead("b2").over(w).alias("b3"), F.lead("b2", 2).over(w).alias("b4"))
    back = Window.partitionBy("doc_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    out = blocks.select("*", own.alias("b2")).select("*", F.lag("b2").over(w).alias("b1"), F.lead("b2").over(w).alias("n1"), F.lead("b2", 2).over(w).alias("n2"))
    kept = F.when(F.col(labels) != ELIMINATE, F.struct(F.col("b2").alias("b3"), F.col("n1").alias("b4")))
    out = out.withColumn("kept", F.last(kept, True).over(back))
    drop = F.coalesce(F.col(labels) == ELIMINATE, F.lit(False))
    return out.withColumn("b3", F.when(drop, F.col("n1")).otherwise(F.col("kept.b3"))).withColumn("b4", F.when(drop, F.col("n2")).otherwise(F.col("kept.b4"))).drop("n1", "n2", "kept")


def _places(found: list[list[dict] | None], labels: list[int | None] | None) -> list[tuple[int, int, int]]:
    """For each line of a document the numbered list after its block 3 (DOWN where there is none), and the lines that are its blocks 3 and 4, as `neighbours` has them."""
    n, listing = len(found), N.NumberedList()
    after = [k + 1 for k in range(n)]
    if labels is not None:
        kept = n
        for k in range(n - 1, -1, -1):
            if labels[k] != ELIMINATE:
                after[k] = kept
            if labels[k] is not None and labels[k] != ELIMINATE:
                kept = k
    return [(listing.push([(c["kind"], c["num"], c["bullet"]) for c in found[b3] or []])[0] if b3 < n else N.DOWN, b3, b3 + 1) for b3 in after]


READY = "__ready"


def ready(blocks: DataFrame, extractor: Extractor) -> DataFrame:
    """Blocks with all columns that features look at. READY marks them, so that those which are kept are not made ready again."""
    if READY in blocks.columns:
        return blocks
    df = extractor.prepared(blocks)
    if "candidates" not in df.columns:
        df = df.withColumn("candidates", N.candidates("text", extractor.language))
    return df.withColumn(READY, F.lit(True))


def _in_context(df: DataFrame, columns: list[str], labels: str | None, known: DataFrame | None) -> DataFrame:
    """df(doc_id, pos, ...) -> (doc_id, pos, b1 .. b4, list_state, columns of known).

    One exchange gathers a document's lines in a row, and what is known of the document is joined to that; only the
    numbers that lines begin with and their labels go to Python. The neighbours are looked up in the row, so nothing that
    holds a text four times is ever dealt out or sorted.
    """
    fields = list(dict.fromkeys(["pos", *columns, *([labels] if labels else [])]))
    docs = df.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("__rows"))
    names = []
    if known is not None:
        names = [c for c in known.columns if c != "doc_id"]
        docs = docs.join(known, "doc_id", "left")

    # made here, as workers import this module and have no session
    @F.arrow_udf("struct<state:array<int>,b3:array<int>,b4:array<int>>")
    def places(found: pa.Array, label: pa.Array) -> pa.Array:
        ends, parts = [0], [array("i"), array("i"), array("i")]
        for k in range(len(found)):  # one document's lines as Python objects at a time
            for row in _places(found[k].as_py(), label[k].as_py()):
                for part, x in zip(parts, row, strict=True):
                    part.append(x)
            ends.append(len(parts[0]))
        offsets = pa.array(ends, pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(np.asarray(x, np.int32), pa.int32())) for x in parts], ["state", "b3", "b4"])

    label = F.col(f"__rows.{labels}").cast("array<int>") if labels else F.lit(None).cast("array<int>")
    docs = docs.withColumn("__at", places(F.col("__rows.candidates"), label))
    blocks = "named_struct('b1', get(__rows, k - 1), 'b2', r, 'b3', get(__rows, get(__at.b3, k)), 'b4', get(__rows, get(__at.b4, k)), 'list_state', get(__at.state, k))"
    lines = docs.select("doc_id", *names, F.explode(F.expr(f"transform(__rows, (r, k) -> {blocks})")).alias("__x"))
    return lines.select("doc_id", F.col("__x.b2.pos").alias("pos"), "__x.*", *names)


def line_features(blocks: DataFrame, extractor: Extractor, labels: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """blocks(doc_id, pos, ...) -> (doc_id, pos, a double column for each feature, in the order of their names), then the columns `keep` of the line."""
    importable(blocks.sparkSession)
    seen = _in_context(ready(blocks, extractor), [*extractor.columns, "candidates", *keep], labels, extractor.constants(blocks))
    made = extractor.line_columns()
    return seen.select("doc_id", "pos", *[made[k].alias(k) for k in sorted(made)], *[F.col(f"b2.{c}").alias(c) for c in keep])


def heads(lines: DataFrame) -> DataFrame:
    """lines(doc_id, pos, label) with cum_down, cum_up (through the line) and head: where the paragraph of the line begins."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    through = w.rowsBetween(Window.unboundedPreceding, 0)
    out = lines.withColumn("cum_down", F.sum((F.col("label") == DOWN).cast("int")).over(through)).withColumn("cum_up", F.sum((F.col("label") == UP).cast("int")).over(through))
    opens = F.when(F.lag("label").over(w).isin(SAME_LEVEL, DOWN, UP), F.col("pos"))
    return out.withColumn("opens", opens).withColumn("head", F.coalesce(F.last("opens", True).over(through), F.first("pos").over(through))).drop("opens")


def pointer_pairs(lines: DataFrame, pointing: Column | None = None) -> DataFrame:
    """lines(doc_id, pos, label, pointer) -> (doc_id, i, j, n_downs, n_ups, n_ups_downs_difference, head, is_target).

    j are the lines with a pointer (or those of `pointing`), i the DOWN lines before them. Conditions go before the join.
    """
    known = heads(lines)
    j = known.where(F.col("pointer").isNotNull() if pointing is None else pointing).select("doc_id", F.col("pos").alias("j"), "pointer", (F.col("cum_down") - (F.col("label") == DOWN).cast("int")).alias("down_j"), (F.col("cum_up") - (F.col("label") == UP).cast("int")).alias("up_j"))
    i = known.where(F.col("label") == DOWN).select("doc_id", F.col("pos").alias("i"), F.col("cum_down").alias("down_i"), F.col("cum_up").alias("up_i"), "head")
    pairs = i.join(j, "doc_id").where("i < j")
    downs, ups = F.col("down_j") - F.col("down_i"), F.col("up_j") - F.col("up_i")
    return pairs.select("doc_id", "i", "j", downs.alias("n_downs"), ups.alias("n_ups"), (ups - downs).alias("n_ups_downs_difference"), "head", F.coalesce(F.col("i") == F.col("pointer"), F.lit(False)).alias("is_target"))


def pointer_features(blocks: DataFrame, extractor: Extractor, pairs: DataFrame) -> DataFrame:
    """pairs with the extractor's pointer features; blocks are looked up by (doc_id, pos)."""
    importable(blocks.sparkSession)
    own = ready(blocks, extractor).select("doc_id", "pos", F.struct("pos", *extractor.columns, "candidates").alias("b"))
    out = pairs.withColumn("j1", F.col("j") + 1)
    for at, name in (("head", "h"), ("i", "t1"), ("j", "t2"), ("j1", "t3")):
        side = own.select("doc_id", F.col("pos").alias(at), F.col("b").alias(name))
        out = out.join(side, ["doc_id", at], "left")
    out = out.withColumn("head", F.col("h"))
    if (known := extractor.constants(blocks)) is not None:
        out = out.join(known, "doc_id", "left")
    made = extractor.pointer_columns()
    counts = [F.col(f"n_{x}").cast("double").alias(f"transition_n_{x}") for x in ("downs", "ups", "ups_downs_difference")]
    return out.select("doc_id", "i", "j", "is_target", *counts, *[made[k].alias(k) for k in sorted(made)])


def compared(a: Column, b: Column, there: Column) -> Column:
    """0 equal, 1 more, 2 less, 3 where one is missing."""
    return F.when(~there, 3).when(a < b, 1).when(a > b, 2).otherwise(0)


class _Lexical(Extractor):
    """What English text and PDF lines have in common."""

    def _there(self, b: Block, c: Column) -> Column:
        return F.when(b.there, c).otherwise(F.lit(False))

    @feature()
    def numbered_list_state(self, b1, b2, b3, b4):
        return {"value": F.col("list_state")}

    @single([2])
    def whereas(self, b):
        return X.whereas(b.text)

    @single([2])
    def therefore(self, b):
        return X.therefore(b.text)

    @single([0, 1])
    def colon_ish(self, b):
        return X.colon_ish(b.text)

    @single([0, 1])
    def punctuated(self, b):
        return X.punctuated(b.text)

    @single([1])
    def list_ish(self, b):
        return X.list_ish(b.text)

    @pairwise([(0, 1), (1, 2)])
    def mask_continuation(self, a, b):
        return X.mask_continuation(a.text, b.text)

    @single([1, 2])
    def all_capital(self, b):
        return X.all_capital(b.text)

    @single([1, 2])
    def space_separated(self, b):
        return X.space_separated(b.text)

    def indent_code(self, a: Block, b: Block) -> Column:
        raise NotImplementedError

    def at_left(self, b: Block) -> Column:
        raise NotImplementedError

    @pairwise([(0, 1), (1, 2)])
    def indent(self, a, b):
        return self.indent_code(a, b)

    @pointer()
    def pointer_section_number(self, head, t1, t2, t3):
        one = lambda before: F.when(t3.there, N.any_next("t3.candidates", before).cast("int")).otherwise(-1)
        return {"3_next_of_1": one("t1.candidates"), "3_next_of_head": one("head.candidates")}

    @pointer()
    def pointer_indent(self, head, t1, t2, t3):
        after = lambda a: F.when(t3.there, self.indent_code(a, t3)).otherwise(-1)
        return {"1_2": self.indent_code(t1, t2), "head_2": self.indent_code(head, t2), "1_3": after(t1), "head_3": after(head)}

    @pointer()
    def pointer_left_aligned(self, head, t1, t2, t3):
        return {"1": self.at_left(t1), "3": F.when(t3.there, self.at_left(t3)).otherwise(F.lit(True)), "head": self.at_left(head)}


class TextContract(_Lexical):
    """Plain text, English."""

    columns = ("text", "text_orig", "indent", "width", "top_spacing", "body")

    def prepared(self, blocks):
        return blocks.withColumn("body", N.body_indent(F.col("text_orig")))

    def constants(self, blocks):
        return text_constants(blocks)

    def indent_code(self, a, b):
        return compared(a.indent, b.indent, a.there & b.there)

    def at_left(self, b):
        return b.indent == 0

    @pairwise([(0, 1), (1, 2)])
    def line_break(self, a, b):
        return F.when(a.there, ~belongs(a.width, "right_margin")).otherwise(F.lit(True))

    @pairwise([(0, 1), (1, 2)])
    def indent_body(self, a, b):
        return compared(a.body, b.body, a.there & b.there)

    @single([1, 2])
    def centered(self, b):
        return self._there(b, (b.indent != 0) & (F.abs(mean("right_margin") - b.width - b.indent) < 8))

    @single([1, 2])
    def extra_line_space(self, b):
        return F.coalesce(b.top_spacing.cast("int"), F.lit(-1))

    @single([1, 2])
    def dict_like(self, b):
        return self._there(b, b.text.contains(":") & ~belongs(b.width, "right_margin"))

    @single([0, 1, 2])
    def page_like1(self, b):
        return X.page_like1(b.text)

    @single([0, 1, 2])
    def page_like2(self, b):
        return X.page_like2(b.text)

    @single([0, 1, 2])
    def horizontal_line(self, b):
        return X.horizontal_line(b.text)


class _Boxes(_Lexical):
    """Boxes on pages."""

    columns = ("text", "page", "x0", "y0", "x1", "y1", "left", "similar")

    def prepared(self, blocks):
        # both are joined on the document alone, so that its lines need no other exchange
        out = blocks.join(similar_lines(blocks), "doc_id", "left").withColumn("similar", F.coalesce(F.array_contains("alike", F.col("pos")), F.lit(False))).drop("alike")
        return out.join(clusters(blocks, "x0", LEFT_THRESH, "clusters_left"), "doc_id", "left").withColumn("left", index_of("x0", "clusters_left")).drop("clusters_left")

    def constants(self, blocks):
        return page_constants(blocks)

    def indent_code(self, a, b):
        return compared(a.left, b.left, a.there & b.there)

    def at_left(self, b):
        return belongs(b.x0, "left_margin")

    @single([1])
    def similar_position_similar_text(self, b):
        return b.similar

    @single([1])
    def header_region(self, b):
        return b.y1 > F.col("header_thresh")

    @single([1])
    def footer_region(self, b):
        return b.y0 < F.col("footer_thresh")

    @pairwise([(0, 1), (1, 2)])
    def line_break(self, a, b):
        return F.when(a.there, ~belongs(a.x1, "right_margin")).otherwise(F.lit(True))

    @single([1, 2])
    def centered(self, b):
        right, left = mean("right_margin") - b.x1, b.x0 - mean("left_margin")
        return self._there(b, ~belongs(b.x0, "left_margin") & (F.abs(right - left) < 20))

    @pairwise([(0, 1), (1, 2)])
    def extra_line_space(self, a, b):
        return F.when(a.there & b.there, ~belongs(a.y0 - b.y0, "line_spacing")).otherwise(F.lit(True))

    @pairwise([(0, 1), (1, 2)])
    def page_change(self, a, b):
        return F.when(a.there & b.there, a.page != b.page).otherwise(F.lit(True))

    def _outer(self, b: Block) -> Column:
        return (b.y0 < 100) | (b.y1 > 700)

    @single([0, 1, 2])
    def page_like(self, b):
        return self._there(b, self._outer(b) & b.text.rlike("[1-9]"))

    def _page_word(self, b: Block) -> Column:
        return b.text.rlike("(?i)page [1-9]")

    @single([0, 1, 2])
    def page_like2(self, b):
        return self._there(b, self._outer(b) & self._page_word(b) & (F.length(F.replace(b.text, F.lit(" "), F.lit(""))) < 10))


class PdfContract(_Boxes):
    """PDF, English."""

    @single([1, 2])
    def dict_like(self, b):
        return self._there(b, b.text.contains(":") & ~belongs(b.x1, "right_margin"))


class PdfContractJa(_Boxes):
    """PDF, Japanese."""

    language = "ja"
    whereas = therefore = list_ish = all_capital = None

    def _page_word(self, b):
        return b.text.rlike(r"(?i)(?:page|ページ|P\.?) [1-9]")

    @single([0, 1])
    def colon_ish(self, b):
        return X.colon_ish(b.text, "-;:,、")

    @single([0, 1])
    def punctuated(self, b):
        return X.punctuated(b.text, ".。")

    @single([0, 1])
    def space_emphasis(self, b):
        return X.space_emphasis(b.text)

    @single([0, 1])
    def parenthesis_emphasis(self, b):
        return X.parenthesis_emphasis(b.text)


class HocrBalanceSheet(_Lexical):
    """Table cells of hOCR pages, Japanese; doc_id is the cell."""

    language = "ja"
    columns = ("text", "x0", "y0", "x1", "y1", "cell_w", "left")
    whereas = therefore = colon_ish = punctuated = list_ish = mask_continuation = all_capital = space_separated = None

    def prepared(self, blocks):
        known = clusters(blocks, "x0", CELL_THRESH, "clusters_left")
        return blocks.join(known, "doc_id", "left").withColumn("left", index_of("x0", "clusters_left")).drop("clusters_left")

    def constants(self, blocks):
        return cell_constants(blocks)

    def indent_code(self, a, b):
        return compared(a.left, b.left, a.there & b.there)

    def at_left(self, b):
        return belongs(b.x0, "left_margin")

    @single([1, 2])
    def centered(self, b):
        right, left = mean("right_margin") - b.x1, b.x0 - mean("left_margin")
        return self._there(b, ~belongs(b.x0, "left_margin") & (F.abs(right - left) < 20))

    @single([1, 2])
    def centered_cell(self, b):
        return self._there(b, F.abs(b.cell_w - b.x1 - b.x0) < 20)

    @single([1, 2])
    def left_aligned(self, b):
        return self._there(b, belongs(b.x0, "left_margin"))

    @single([1, 2])
    def right_aligned(self, b):
        return self._there(b, belongs(b.x0, "right_margin"))

    @single([1])
    def stretched(self, b):
        return F.coalesce(F.length(b.text) / F.nullif(b.x1 - b.x0, F.lit(0)) - F.col("char_per_pt") > 1, F.lit(False))

    @pairwise([(0, 1), (1, 2)])
    def extra_line_space(self, a, b):
        return F.when(a.there & b.there, ~belongs(a.y0 - b.y0, "line_spacing")).otherwise(F.lit(True))

    @single([1, 2])
    def parenthesized(self, b):
        return self._there(b, b.text.rlike(r"^\([^)]+\)$|^[^(]+\)$|^\([^)]+$"))

    @pairwise([(0, 1), (1, 2)])
    def common_substrings(self, a, b):
        return X.common_bigram(a.text, b.text)

    @single([1])
    def dict_nobu(self, b):
        return self._there(b, b.text.contains("の部"))

    @single([1, 2])
    def dict_sonota(self, b):
        return self._there(b, b.text.contains("その他"))

    @single([1, 2])
    def dict_uchi(self, b):
        return self._there(b, b.text.contains("うち"))

    @single([1, 2])
    def dict_gokei(self, b):
        return self._there(b, b.text.contains("合計"))


def with_language_model(base: type[Extractor], scorer: Callable[[Column, Column, Column, str], Column]) -> type[Extractor]:
    """An extractor with the two coherence features; scorer(a, b, context, "prev" or "next") gives the difference of losses."""

    class WithModel(base):
        @feature()
        def language_model_coherence(self, b1, b2, b3, b4):
            one = lambda c: F.when(b1.there & b3.there, c).otherwise(0.0)
            return {"loss_diff_next": one(scorer(b2.text, b3.text, b1.text, "prev")), "loss_diff_prev": one(scorer(b2.text, b1.text, b3.text, "next"))}

    WithModel.__name__ = f"{base.__name__}WithModel"
    return WithModel


EXTRACTORS: dict[str, type[Extractor]] = {"text_contract": TextContract, "pdf_contract": PdfContract, "pdf_contract_ja": PdfContractJa, "hocr_balance_sheet_ja": HocrBalanceSheet}
