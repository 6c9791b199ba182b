"""The registered queries of the engine's own operators and their SQL (None of them cuts a table or a text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbering as N
from ..functions import text as X
from ..operators import baselines as B
from ..operators import layout as L
from ..operators import metrics as M
from ..operators import structure as S
from ..operators.fold import importable
from ..plans import export, features, model
from ..sources import annotations as A
from ..sources import hocr, text
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = f"{V.DUCK} {sql}"
        return f

    return add


def _of(name: str, view: Callable, column: Callable, sql: str, source: str, out: str = "value") -> None:
    """A query of one column over every line of a view."""
    QUERIES[name] = lambda spark, sf_dir: view(spark, sf_dir).select("doc_id", "pos", column().alias(out))
    ORACLES[name] = f"{V.DUCK} SELECT doc_id, pos, {sql} AS {out} FROM {source}"


def _with_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.layout(spark, sf_dir).withColumn("after", F.lead("text").over(Window.partitionBy("doc_id").orderBy("pos")))


_NEXT = "(SELECT doc_id, pos, text, lead(text) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM v_layout)"


def _t(f: Callable, **kw: object) -> Callable:
    return lambda: f(F.col("text"), **kw)


# scalar functions over lines
_of("whereas", V.layout, _t(X.whereas), "starts_with(lower(trim(text)), 'whereas')", "v_layout")
_of("therefore", V.layout, _t(X.therefore), "regexp_matches(trim(text), '^(?i:now[ ,]+ therefore)')", "v_layout")
_of("colon_ish", V.layout, _t(X.colon_ish), "right(trim(text), 1) IN ('-', ';', ':', ',')", "v_layout")
_of("punctuated", V.layout, _t(X.punctuated), "right(trim(text), 1) = '.'", "v_layout")
_of("list_ish", V.layout, _t(X.list_ish), "regexp_matches(text, '(?i).(?:,|;|and|or) *$')", "v_layout")
_of("all_capital", V.layout, _t(X.all_capital), "CAST(upper(text) = text AS INT)", "v_layout")
_of("space_separated", V.layout, _t(X.space_separated), "coalesce((length(trim(text)) - length(replace(trim(text), ' ', ''))) / nullif(length(text), 0)::DOUBLE, 0)", "v_layout")
_of("horizontal_line", V.layout, _t(X.horizontal_line), "length(trim(text)) >= 3 AND (" + " OR ".join(f"regexp_matches(trim(text), '^{c}[{c} ]*$')" for c in ("[*]", "-", "=", "#", "%", "_", "[+]")).replace("[[*]", "[*").replace("[[+]", "[+") + ")", "v_layout")
_of("page_like1", V.layout, _t(X.page_like1), "regexp_matches(text, 'page [1-9]|PAGE')", "v_layout")
_of("page_like2", V.layout, _t(X.page_like2), "regexp_matches(text, '[0-9]/[1-9]|- ?[0-9]+ ?-')", "v_layout")
_of("body_indent", V.layout, lambda: N.body_indent(F.col("text")), f"length(regexp_extract(text, '{N.BODY}', 0))", "v_layout")
_of("mask_continuation", _with_next, lambda: X.mask_continuation(F.col("text"), F.col("after")), "coalesce(ends_with(trim(text), '__') AND starts_with(trim(after), '__'), false)", _NEXT)
_of("common_bigram", _with_next, lambda: X.common_bigram(F.col("text"), F.col("after")), "coalesce(list_has_any(list_transform(range(1, length(text)), lambda k: substr(text, k, 2)), list_transform(range(1, length(after)), lambda k: substr(after, k, 2))), false)", _NEXT)
_of("translate_marks", V.lines, lambda: X.translated(F.col("text")), f"translate(replace(text, chr(13) || chr(10), chr(10)), chr(13) || chr(10) || '{X._FROM[2:]}', '{X._TO}')", "v_lines", "text")


@_query()
def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised lines; NFKC is not in SQL."""
    importable(spark)
    return V.lines(spark, sf_dir).select("doc_id", "pos", X.normalized(F.col("text")).alias("text"))


@_query()
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance of each line to the next; the SQL engine at hand counts bytes, so tests check it."""
    importable(spark)
    found = _with_next(spark, sf_dir).where("after IS NOT NULL").withColumn("distance", X.edit_distance(F.col("text"), F.col("after")))
    return found.select("doc_id", "pos", "distance", (F.col("distance") / F.greatest(F.length("text"), F.length("after"))).alias("share"))


@_query("SELECT doc_id, pos, text FROM v_lines")
def lines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.lines(spark, sf_dir)


_PAGE_LINES = "(SELECT page_id AS doc_id, unnest(string_split(replace(html, '>', '>' || chr(10)), chr(10))) AS line, unnest(range(len(string_split(replace(html, '>', '>' || chr(10)), chr(10))))) AS n FROM pages)"


@_query(f"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INT AS pos, trim(line, ' ') AS text, (length(line) - length(ltrim(line, ' ')))::INT AS indent, length(rtrim(line, ' '))::INT AS width, top_spacing, bottom_spacing, line AS text_orig
FROM (SELECT *, coalesce(trim(lag(line) OVER w, ' ') = '', true) AS top_spacing, coalesce(trim(lead(line) OVER w, ' ') = '', true) AS bottom_spacing FROM {_PAGE_LINES} WINDOW w AS (PARTITION BY doc_id ORDER BY n)) WHERE trim(line, ' ') <> ''""")
def line_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut after every tag: blank lines between tags give the spacing."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    cut = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(F.split(F.replace("html", F.lit(">"), F.lit(">\n")), "\n")).alias("line_no", "line"))
    return text.text_blocks(cut, normalize=False)


@_query("SELECT DISTINCT url, regexp_replace(regexp_extract(url, '[^/]+$', 0), '[.][^./]*$', '') AS file_key FROM pages")
def file_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", text.file_key(F.col("url")).alias("file_key")).distinct()


# layout
def _duck_clusters(value: str, source: str, thresh: float, p: str = "") -> str:
    """SQL: (doc_id, k, mn, mx, n, mean) of greedy clusters; each cluster begins at the least value beyond the one before."""
    return f"""{p}vals AS (SELECT doc_id, CAST({value} AS DOUBLE) AS v, count(*) AS n FROM {source} GROUP BY ALL),
    {p}cl(doc_id, k, mn) AS (SELECT doc_id, 0, min(v) FROM {p}vals GROUP BY doc_id UNION ALL
        SELECT c.doc_id, c.k + 1, min(x.v) FROM {p}cl c JOIN {p}vals x ON x.doc_id = c.doc_id AND x.v - c.mn > {thresh} GROUP BY ALL),
    {p}found AS (SELECT c.doc_id, c.k, c.mn, max(v) AS mx, sum(n)::BIGINT AS n, sum(v * n) / sum(n) AS mean FROM {p}cl c JOIN {p}vals x ON x.doc_id = c.doc_id AND x.v >= c.mn AND x.v - c.mn <= {thresh} GROUP BY ALL)"""


def _spread(found: DataFrame, name: str) -> DataFrame:
    return found.select("doc_id", F.posexplode(name).alias("k", "c")).select("doc_id", "k", "c.mn", "c.mx", "c.n", (F.col("c.total") / F.col("c.n")).alias("mean"))


@_query(f", {_duck_clusters('x0', 'v_boxes', 10)} SELECT * FROM found")
def cluster_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(L.clusters(V.boxes(spark, sf_dir), "x0", 10), "clusters")


@_query(f", {_duck_clusters('x1', 'v_boxes', 10)} SELECT * FROM found")
def cluster_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(L.clusters(V.boxes(spark, sf_dir), "x1", 10), "clusters")


_WIDTHS = "(SELECT doc_id, length(trim(text, ' ')) + indent AS width FROM v_layout WHERE trim(text, ' ') <> '')"


@_query(f", {_duck_clusters('width', _WIDTHS, 8)} SELECT doc_id, mn, mx, n, mean FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (n >= 5) DESC, k DESC) AS r FROM found) WHERE r = 1")
def margins_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.text_constants(V.text_blocks(spark, sf_dir)).select("doc_id", "right_margin.mn", "right_margin.mx", "right_margin.n", L.mean("right_margin").alias("mean"))


@_query(f""", pages_of AS (SELECT doc_id, count(DISTINCT page) AS p FROM v_boxes GROUP BY 1), {_duck_clusters('x0', 'v_boxes', 10)}
SELECT doc_id, mn, mx, n, mean FROM (SELECT found.*, row_number() OVER (PARTITION BY doc_id ORDER BY (n >= 6 * p + 1) DESC, k) AS r FROM found JOIN pages_of USING (doc_id)) WHERE r = 1""")
def margins_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page_constants(V.boxes(spark, sf_dir)).select("doc_id", "left_margin.mn", "left_margin.mx", "left_margin.n", L.mean("left_margin").alias("mean"))


_GAPS = "(SELECT doc_id, y0 - y AS gap FROM (SELECT doc_id, page, y0, lead(page) OVER w AS p, lead(y0) OVER w AS y FROM v_boxes WINDOW w AS (PARTITION BY doc_id ORDER BY page, y0 DESC, x0)) WHERE p = page)"


@_query(f", {_duck_clusters('gap', _GAPS, 2)} SELECT doc_id, mn, mx, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, mn) AS r FROM found) WHERE r = 1")
def line_spacing_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.spacing(V.boxes(spark, sf_dir)).select("doc_id", "line_spacing.mn", "line_spacing.mx", "line_spacing.n")


@_query("SELECT doc_id, max(y1) - 0.15::DOUBLE * (max(y1) - min(y0)) AS header_thresh, min(y0) + 0.15::DOUBLE * (max(y1) - min(y0)) AS footer_thresh FROM v_boxes GROUP BY doc_id")
def header_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page_constants(V.boxes(spark, sf_dir)).select("doc_id", "header_thresh", "footer_thresh")


_MERGE = """, fr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, ny0, x0, x1, y1, text) - 1 AS i FROM (
        SELECT doc_id, page, -y0 AS ny0, x0, (x0 + x1) / 2 AS x1, y1, CASE WHEN instr(text, ' ') > 1 THEN substr(text, 1, instr(text, ' ') - 1) ELSE text END AS text, block FROM v_boxes
        UNION ALL SELECT doc_id, page, -y0, (x0 + x1) / 2 + 6, x1, y1, substr(text, instr(text, ' ') + 1), block FROM v_boxes WHERE instr(text, ' ') > 1)),
    other AS (SELECT a.doc_id, a.i, min(b.i) AS n FROM fr a JOIN fr b ON b.doc_id = a.doc_id AND b.i > a.i AND b.page <= a.page + 1
        AND NOT coalesce(a.page = b.page AND (least(a.y1, b.y1) + a.ny0) / nullif(greatest(a.y1, b.y1) + b.ny0, 0) > 0.5, false) GROUP BY ALL),
    opens(doc_id, i) AS (SELECT doc_id, min(i) FROM fr GROUP BY doc_id UNION ALL SELECT other.doc_id, other.n FROM opens JOIN other ON other.doc_id = opens.doc_id AND other.i = opens.i),
    gr AS (SELECT fr.*, max(opens.i) OVER (PARTITION BY fr.doc_id ORDER BY fr.i ROWS UNBOUNDED PRECEDING) AS g FROM fr LEFT JOIN opens ON opens.doc_id = fr.doc_id AND opens.i = fr.i),
    sized AS (SELECT doc_id, g, n, row_number() OVER w - 1 AS pos, lag(n) OVER w AS before, lead(n) OVER w IS NULL AS final FROM (SELECT doc_id, g, count(*) AS n FROM gr GROUP BY ALL) WINDOW w AS (PARTITION BY doc_id ORDER BY g)),
    reached AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, g ORDER BY x0, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM gr)
SELECT doc_id, pos::INT AS pos, page, min(x0) AS x0, min(-ny0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(repeat(' ', coalesce(floor(greatest(x0 - reach, 0) / 4), 0)::INT) || text, '' ORDER BY x0, i) AS text, list_sort(list(DISTINCT block::VARCHAR)) AS blocks
FROM reached JOIN sized USING (doc_id, g) WHERE NOT (final AND n = 1 AND coalesce(before, 0) > 1) GROUP BY doc_id, pos, page"""


@_query(_MERGE)
def merge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes cut at a blank and merged again."""
    return L.merge_lines(V.fragments(spark, sf_dir))


@_query()
def repeated_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.similar_elsewhere(V.boxes(spark, sf_dir))


# annotations
def _annotation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.element_at(F.array(*map(F.lit, "csdse")), F.col("label") + 1)
    line = F.concat_ws("\t", F.lit("text"), F.coalesce(F.col("pointer") + 1, F.lit(0)).cast("string"), key)
    return V.gold(spark, sf_dir).select(F.col("doc_id").alias("file_key"), F.col("pos").alias("line_no"), line.alias("line"))


@_query("SELECT doc_id AS file_key, pos, label, pointer FROM v_gold")
def anno_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold labels written as annotation lines and parsed again."""
    return A.annotations(_annotation_lines(spark, sf_dir))


_EXCLUDED = "(SELECT doc_id, pos, CASE WHEN label <> 2 AND (doc_id + pos) % 11 = 0 THEN -1 ELSE label END AS label, CASE WHEN (doc_id + pos) % 11 = 0 THEN NULL ELSE pointer END AS pointer FROM v_gold)"


@_query(f""", x AS (SELECT *, coalesce(sum((label = -1)::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM {_EXCLUDED})
SELECT a.doc_id, (a.pos - a.gone)::INT AS pos, a.label, (a.pointer - b.gone)::INT AS pointer FROM x a LEFT JOIN x b ON a.doc_id = b.doc_id AND a.pointer = b.pos WHERE a.label <> -1""")
def exclude_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = V._over(V.gold(spark, sf_dir), "v_gold", f"SELECT * FROM {_EXCLUDED}")
    return A.without_excluded(marked)


@_query("SELECT doc_id, pos, concat(text, chr(9), '0', chr(9)) AS line FROM v_lines")
def skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.skeleton(V.lines(spark, sf_dir))


@_query("""SELECT doc_id, pos, lag(pos) OVER w AS b1, CASE WHEN label = 4 THEN lead(pos) OVER w ELSE min(CASE WHEN label <> 4 THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END AS b3
FROM v_gold WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""")
def next_kept_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = features.neighbours(V.gold(spark, sf_dir), ["label"], "label")
    return seen.select("doc_id", "pos", F.col("b1.pos").alias("b1"), F.col("b3.pos").alias("b3"))


# numbering
def _shown(found: str) -> Column:
    return F.expr(f"array_join(transform({found}, c -> concat(c.kind, ':', coalesce(c.bullet, cast(c.num AS STRING)))), '|')")


def _duck_candidate_list() -> str:
    t = "trim(text)"
    parts = [f"CASE WHEN regexp_matches({t}, '^{N.BULLETS}') THEN 'bullet_point:' || substr({t}, 1, 1) END"]
    for kind in N.EN:
        for form in N.forms(kind):
            m = f"regexp_extract({t}, '{form}', 1)"
            roman = "CASE upper({0}) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in N.ROMAN_VALUES.items()) + " END"
            value = roman if kind.name.startswith("roman") else "ascii(lower({0})) - 96" if kind.name.startswith("alph") else "TRY_CAST({0} AS INT)"
            parts.append(f"CASE WHEN regexp_matches({t}, '{form}') THEN '{kind.name}:' || ({value.format(m)})::VARCHAR END")
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


_CANDIDATES = f"SELECT doc_id, pos, {_duck_candidate_list()} AS cs FROM v_layout"
_AFTER = "CASE WHEN starts_with({0}, 'bullet_point:') THEN {0} ELSE split_part({0}, ':', 1) || ':' || (TRY_CAST(split_part({0}, ':', 2) AS INT) + 1)::VARCHAR END"
#: (doc_id, pos, state, anchor) of the numbered list: `due` are the numbers that may come next at each level, `own` the lines of their last ones.
_LISTING = f""", cand AS ({_CANDIDATES}), listing(doc_id, pos, due, own, state, anchor) AS (
    SELECT doc_id, -1, []::VARCHAR[], []::INT[], 0, NULL::INT FROM v_layout GROUP BY doc_id UNION ALL
    SELECT doc_id, pos, CASE WHEN new IS NULL THEN due ELSE list_append(due[1:keep], {_AFTER.format('new')}) END, CASE WHEN new IS NULL THEN own ELSE list_append(own[1:keep], pos) END,
        CASE WHEN none THEN 0 WHEN k > 0 THEN CASE WHEN k = len(due) THEN 1 ELSE 3 END WHEN new IS NULL THEN 4 ELSE 2 END, CASE WHEN k > 0 AND k < len(due) THEN own[k] END
    FROM (SELECT *, CASE WHEN k > 0 THEN k - 1 ELSE len(due) END AS keep, CASE WHEN k > 0 THEN due[k] ELSE list_filter(cs, lambda c: starts_with(c, 'bullet_point:') OR TRY_CAST(split_part(c, ':', 2) AS INT) <= 1)[1] END AS new
        FROM (SELECT c.doc_id, c.pos, c.cs, len(c.cs) = 0 AS none, l.due, l.own, coalesce(list_max(list_transform(range(1, len(l.due) + 1), lambda i: CASE WHEN list_contains(c.cs, l.due[i]) THEN i ELSE 0 END)), 0) AS k
            FROM listing l JOIN cand c ON c.doc_id = l.doc_id AND c.pos = l.pos + 1)))"""


@_query(f"SELECT doc_id, pos, array_to_string({_duck_candidate_list()}, '|') AS candidates FROM v_layout")
def section_candidates_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.layout(spark, sf_dir).withColumn("found", N.candidates("text")).select("doc_id", "pos", _shown("found").alias("candidates"))


@_query()
def section_candidates_ja(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.layout(spark, sf_dir).withColumn("found", N.candidates("text", "ja")).select("doc_id", "pos", _shown("found").alias("candidates"))


@_query(f""", cand AS (SELECT *, lag(cs) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM ({_CANDIDATES}))
SELECT doc_id, pos, len(list_intersect(cs, list_transform(before, lambda b: {_AFTER.format('b')}))) > 0 AS value FROM cand WHERE before IS NOT NULL""")
def is_next_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a line's number follows that of the line before it."""
    own = V.layout(spark, sf_dir).withColumn("found", N.candidates("text"))
    own = own.withColumn("before", F.lag("found").over(Window.partitionBy("doc_id").orderBy("pos")))
    return own.where("before IS NOT NULL").select("doc_id", "pos", N.any_next("found", "before").alias("value"))


@_query(f"{_LISTING} SELECT doc_id, pos, state FROM listing WHERE pos >= 0")
def numbered_list_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.numbered_list_states(V.layout(spark, sf_dir).withColumn("candidates", N.candidates("text")))


# features
@_query()
def features_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.line_features(V.text_blocks(spark, sf_dir), features.TextContract())


@_query()
def features_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.line_features(V.boxes(spark, sf_dir), features.PdfContract())


@_query()
def features_ja(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.line_features(V.boxes(spark, sf_dir), features.PdfContractJa())


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.boxes(spark, sf_dir).drop("page").withColumn("cell_w", F.lit(612.0))


@_query()
def features_hocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.line_features(_cells(spark, sf_dir), features.HocrBalanceSheet())


_HEADS = """, cum AS (SELECT *, sum((label = 2)::INT) OVER w AS d, sum((label = 3)::INT) OVER w AS u, coalesce(max(CASE WHEN before IN (1, 2, 3) THEN pos END) OVER w, 0) AS head
    FROM (SELECT *, lag(label) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM v_gold) WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))"""


@_query(_HEADS + """ SELECT i.doc_id, i.pos AS i, j.pos AS j, (j.d - (j.label = 2)::INT - i.d)::BIGINT AS n_downs, (j.u - (j.label = 3)::INT - i.u)::BIGINT AS n_ups, (j.u - (j.label = 3)::INT - i.u - j.d + (j.label = 2)::INT + i.d)::BIGINT AS n_ups_downs_difference, i.head, i.pos = j.pointer AS is_target
FROM cum i JOIN cum j ON i.doc_id = j.doc_id AND i.pos < j.pos AND i.label = 2 AND j.pointer IS NOT NULL""")
def pointer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.pointer_pairs(V.gold(spark, sf_dir))


@_query(_HEADS + " SELECT doc_id, pos, head FROM cum")
def pointer_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.heads(V.gold(spark, sf_dir)).select("doc_id", "pos", "head")


@_query()
def pointer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.pointer_features(V.text_blocks(spark, sf_dir), features.TextContract(), features.pointer_pairs(V.gold(spark, sf_dir)))


# baselines
def _duck_by_depth(source: str) -> str:
    """SQL: by_depth(doc_id, pos, label, pointer) of source(doc_id, pos, depth, starts): `ps` and `ds` are the lines that are open and their depths."""
    return f"""stepped(doc_id, pos, depth, ps, ds, label, pointer) AS (SELECT doc_id, pos, depth, [pos], [depth], NULL::INT, NULL::INT FROM {source} WHERE pos = 0 UNION ALL
        SELECT doc_id, pos, depth, list_append(ps[1:k], pos), list_append(ds[1:k], depth), CASE WHEN depth < before THEN 3 WHEN depth > before THEN 2 WHEN starts THEN 1 ELSE 0 END, CASE WHEN depth < before THEN CASE WHEN k = 0 THEN -1 ELSE ps[k] END END
        FROM (SELECT n.doc_id, n.pos, n.depth, n.starts, s.depth AS before, s.ps, s.ds, CASE WHEN n.depth < s.depth THEN list_max(list_transform(range(0, len(s.ds) + 1), lambda i: CASE WHEN i > 0 AND s.ds[i] = n.depth THEN i ELSE 0 END)) ELSE len(s.ds) END AS k
            FROM stepped s JOIN {source} n ON n.doc_id = s.doc_id AND n.pos = s.pos + 1)),
    by_depth AS (SELECT doc_id, pos, coalesce(lead(label) OVER w, 3) AS label, CASE WHEN lead(label) OVER w IS NULL THEN -1 ELSE lead(pointer) OVER w END AS pointer FROM stepped WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"""


_INDENTED = f""", depths AS (SELECT doc_id, pos, indent AS depth, top_spacing AS starts FROM v_layout), {_duck_by_depth('depths')}"""


@_query(f"{_INDENTED} SELECT * FROM by_depth")
def baseline_indent_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.by_indent(V.layout(spark, sf_dir))


@_query("""SELECT doc_id, pos, CASE WHEN after IS NULL OR after < indent THEN 3 WHEN after > indent THEN 2 WHEN spaced THEN 1 ELSE 0 END AS label
FROM (SELECT doc_id, pos, indent, lead(indent) OVER w AS after, lead(top_spacing) OVER w AS spaced FROM v_layout WINDOW w AS (PARTITION BY doc_id ORDER BY pos))""")
def baseline_indent_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.by_indent(V.layout(spark, sf_dir)).select("doc_id", "pos", "label")


@_query(f""", {_duck_clusters('x0', 'v_boxes', 10)}, {_duck_clusters('gap', _GAPS, 2, 'gap_')}, spaced AS (SELECT doc_id, mn, mx FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, mn) AS r FROM gap_found) WHERE r = 1),
    depths AS (SELECT b.doc_id, b.pos, f.k AS depth, NOT coalesce(gap > s.mx - 2 AND gap < s.mn + 2, false) AS starts
        FROM (SELECT *, CASE WHEN lag(page) OVER w = page THEN lag(y0) OVER w - y0 END AS gap FROM v_boxes WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) b
        JOIN found f ON f.doc_id = b.doc_id AND b.x0 BETWEEN f.mn AND f.mx LEFT JOIN spaced s ON s.doc_id = b.doc_id), {_duck_by_depth('depths')}
SELECT * FROM by_depth""")
def baseline_indent_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.by_position(V.boxes(spark, sf_dir))


@_query(f"""{_LISTING} SELECT doc_id, pos, CASE WHEN after IS NULL THEN 3 ELSE CASE after WHEN 4 THEN 1 ELSE after END END AS label, CASE WHEN after IS NULL THEN -1 WHEN after = 3 THEN resumed END AS pointer
FROM (SELECT doc_id, pos, lead(state) OVER w AS after, lead(anchor) OVER w AS resumed FROM listing WHERE pos >= 0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos))""")
def baseline_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.by_numbering(V.layout(spark, sf_dir).withColumn("candidates", N.candidates("text")))


@_query("""SELECT doc_id, pos, CASE WHEN after IS NULL THEN 3 WHEN block = after THEN 0 ELSE 1 END AS label, CASE WHEN after IS NULL THEN -1 END AS pointer
FROM (SELECT doc_id, pos, block, lead(block) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM v_boxes)""")
def baseline_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.by_blocks(V.block_boxes(spark, sf_dir))


# structure
def _duck_rel(view: str, name: str) -> str:
    """SQL: src_{name}(doc_id, i, l, src) and {name}(doc_id, i, j, rel)."""
    return f"""k_{name} AS (SELECT doc_id, pos, label, pointer FROM {view} WHERE label <> 4),
    e_{name} AS (SELECT doc_id, pos AS i, lag(pos) OVER w AS pv, lag(label) OVER w AS l, lag(pointer) OVER w AS pp FROM k_{name} WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    src_{name} AS (SELECT doc_id, i, l, CASE WHEN l = 3 THEN pp ELSE pv END AS src FROM e_{name} WHERE pv IS NOT NULL),
    {name}(doc_id, i, j, rel) AS (SELECT doc_id, src, i, CASE WHEN l = 0 THEN 0 WHEN l = 2 THEN 2 ELSE 1 END FROM src_{name} UNION ALL
        SELECT r.doc_id, r.i, s.i, CASE WHEN s.l = 0 THEN r.rel WHEN s.l = 2 THEN 2 ELSE CASE r.rel WHEN 0 THEN 1 ELSE r.rel END END
        FROM {name} r JOIN src_{name} s ON s.doc_id = r.doc_id AND s.src = r.j WHERE NOT (s.l = 2 AND r.rel = 1))"""


_REL = f", {_duck_rel('v_gold', 'rel')}"


@_query(f"{_REL} SELECT * FROM rel")
def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hierarchy(V.gold(spark, sf_dir))


@_query(f"{_REL} SELECT doc_id, pos, list_sort(list(DISTINCT other)) AS others FROM (SELECT doc_id, i AS pos, j AS other FROM rel WHERE rel = 1 UNION ALL SELECT doc_id, j, i FROM rel WHERE rel = 1) GROUP BY ALL")
def birelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.birelation(S.hierarchy(V.gold(spark, sf_dir)), S.SIBLING)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.gold(spark, sf_dir).join(V.lines(spark, sf_dir), ["doc_id", "pos"])


_LEVELS = f"""{_REL}, lev(doc_id, i, level) AS (SELECT doc_id, min(pos), 0 FROM k_rel GROUP BY doc_id UNION ALL
    SELECT s.doc_id, s.i, lev.level + (s.l = 2)::INT FROM lev JOIN src_rel s ON s.doc_id = lev.doc_id AND s.src = lev.i)"""


_PARAGRAPHS = f"""{_LEVELS}, p AS (SELECT e.doc_id, e.i, e.l, t.text, lev.level, sum((e.l IS DISTINCT FROM 0)::INT) OVER (PARTITION BY e.doc_id ORDER BY e.i) - 1 AS para FROM e_rel e JOIN v_lines t ON t.doc_id = e.doc_id AND t.pos = e.i JOIN lev ON lev.doc_id = e.doc_id AND lev.i = e.i)
SELECT doc_id, para::INT AS para_idx, rtrim(string_agg(rtrim(text, ' '), ' ' ORDER BY i), ' ') AS text, min(level)::INT AS level, min(i) AS first_pos FROM p GROUP BY doc_id, para"""


@_query(_PARAGRAPHS)
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.paragraphs(_labelled(spark, sf_dir)).withColumn("text", F.rtrim("text"))


@_query(f"""{_INDENTED}, e AS (SELECT doc_id, pos AS i, lag(pos) OVER w AS pv, lag(label) OVER w AS l, lag(pointer) OVER w AS pp FROM by_depth WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    lev(doc_id, i, level) AS (SELECT doc_id, i, 0 FROM e WHERE pv IS NULL OR l = 3 AND pp = -1 UNION ALL
        SELECT e.doc_id, e.i, lev.level + (e.l = 2)::INT FROM lev JOIN e ON e.doc_id = lev.doc_id AND lev.i = CASE WHEN e.l = 3 THEN e.pp ELSE e.pv END),
    p AS (SELECT e.doc_id, e.i, t.text, lev.level, sum((e.l IS DISTINCT FROM 0)::INT) OVER (PARTITION BY e.doc_id ORDER BY e.i) - 1 AS para FROM e JOIN v_layout t ON t.doc_id = e.doc_id AND t.pos = e.i JOIN lev ON lev.doc_id = e.doc_id AND lev.i = e.i)
SELECT doc_id, para::INT AS para_idx, rtrim(string_agg(rtrim(text, ' '), ' ' ORDER BY i), ' ') AS text, min(level)::INT AS level, min(i) AS first_pos FROM p GROUP BY doc_id, para""")
def paragraphs_indent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines -> labels by indent -> paragraphs with levels."""
    lines = V.layout(spark, sf_dir)
    return S.paragraphs(B.by_indent(lines).join(lines.select("doc_id", "pos", "text"), ["doc_id", "pos"])).withColumn("text", F.rtrim("text"))


@_query(f"""{_REL}, both_rel AS (SELECT doc_id, i AS pos, j AS o, rel, true AS up FROM rel UNION ALL SELECT doc_id, j, i, rel, false FROM rel),
    placed AS (SELECT doc_id, pos, label, head, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS node FROM (SELECT v.doc_id, v.pos, v.label, r.j IS NULL AS head FROM v_gold v LEFT JOIN (SELECT DISTINCT doc_id, j FROM rel WHERE rel = 0) r ON r.doc_id = v.doc_id AND r.j = v.pos)),
    near AS (SELECT a.doc_id, a.node, b.rel, b.up, b.o, t.node AS other FROM placed a JOIN both_rel b ON b.doc_id = a.doc_id AND b.pos = a.pos JOIN placed t ON t.doc_id = a.doc_id AND t.pos = b.o WHERE a.head),
    kids AS (SELECT f.doc_id, f.node, list_sort(list(DISTINCT t.node::INT)) AS children FROM (SELECT doc_id, node, min(o) AS o FROM near WHERE rel = 2 AND up GROUP BY ALL) f JOIN both_rel b ON b.doc_id = f.doc_id AND b.pos = f.o AND b.rel = 1
        JOIN placed t ON t.doc_id = f.doc_id AND t.pos = b.o WHERE t.node <> f.node GROUP BY ALL),
    kin AS (SELECT doc_id, node, list_sort(list(DISTINCT other::INT) FILTER (rel = 1 AND other <> node)) AS siblings, list_sort(list(DISTINCT other::INT) FILTER (rel = 2 AND NOT up AND other <> node)) AS ancestors, arg_max(other, o) FILTER (rel = 2 AND NOT up) AS parent,
        list_sort(list(DISTINCT other::INT) FILTER (rel = 2 AND up AND other <> node)) AS descendents FROM near GROUP BY ALL),
    wholes AS (SELECT a.doc_id, a.node, a.label, string_agg(l.text, ' ' ORDER BY l.pos) AS text FROM placed a JOIN (SELECT doc_id, pos AS p, pos FROM v_gold UNION ALL SELECT doc_id, i, j FROM rel WHERE rel = 0) s ON s.doc_id = a.doc_id AND s.p = a.pos
        JOIN v_lines l ON l.doc_id = a.doc_id AND l.pos = s.pos WHERE a.head GROUP BY ALL)
SELECT w.doc_id, w.node::INT AS node, w.text, coalesce(siblings, []) AS siblings, coalesce(ancestors, []) AS ancestors, parent::INT AS parent, coalesce(descendents, []) AS descendents, coalesce(children, []) AS children, w.label = 4 AS eliminated
FROM wholes w LEFT JOIN kin ON kin.doc_id = w.doc_id AND kin.node = w.node LEFT JOIN kids ON kids.doc_id = w.doc_id AND kids.node = w.node""")
def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tree(_labelled(spark, sf_dir))


@_query(f"""{_REL}, both_rel AS (SELECT doc_id, i AS pos, j AS o, rel, true AS up FROM rel UNION ALL SELECT doc_id, j, i, rel, false FROM rel)
SELECT v.doc_id, v.pos, coalesce(list_sort(list(o) FILTER (rel = 0)), []) AS continual, coalesce(list_sort(list(o) FILTER (rel = 1)), []) AS siblings, coalesce(list_sort(list(o) FILTER (rel = 2 AND NOT up)), []) AS ancestors,
    max(o) FILTER (rel = 2 AND NOT up) AS parent, coalesce(list_sort(list(o) FILTER (rel = 2 AND up)), []) AS descendents
FROM v_gold v LEFT JOIN both_rel b ON b.doc_id = v.doc_id AND b.pos = v.pos GROUP BY v.doc_id, v.pos""")
def line_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.line_relations(V.gold(spark, sf_dir)).drop("children")


@_query()
def relation_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON object of span relations for each document."""
    return export.relation_json(V.gold(spark, sf_dir).join(V.block_boxes(spark, sf_dir).select("doc_id", "pos", "text", F.array(F.concat(F.lit("line "), F.col("pos").cast("string"))).alias("blocks")), ["doc_id", "pos"]))


@_query()
def prediction_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.prediction_json(V.lines(spark, sf_dir), V.gold(spark, sf_dir), V.pred(spark, sf_dir))


@_query(f"{_PARAGRAPHS.rsplit('SELECT doc_id, para::INT', 1)[0]} SELECT doc_id, para_idx, repeat(chr(9), level) || text AS line FROM (SELECT doc_id, para::INT{_PARAGRAPHS.rsplit('SELECT doc_id, para::INT', 1)[1]})")
def tabbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.tabbed(S.paragraphs(_labelled(spark, sf_dir)).withColumn("text", F.rtrim("text")))


# scores
def _duck_scores(classes: list[tuple[str, str, str]], source: str) -> str:
    """SQL: the scores of classes (name, gold test, predicted test) over source(doc_id, gold, pred)."""
    counts = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS class, sum(({g} AND {p})::INT) AS tp, sum((NOT {g} AND {p})::INT) AS fp, sum(({g} AND NOT {p})::INT) AS fn, sum((NOT {g} AND NOT {p})::INT) AS tn FROM {source} GROUP BY doc_id" for n, g, p in classes)
    return _duck_score_counts(counts)


def _duck_score_counts(counts: str) -> str:
    ratios = lambda pre: f"coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS {pre}precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS {pre}recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS {pre}f1"
    return f""", c AS ({counts}), mi AS (SELECT class, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM c GROUP BY class),
    ma AS (SELECT class, avg(p.precision) AS macro_precision, avg(p.recall) AS macro_recall, avg(p.f1) AS macro_f1 FROM (SELECT class, {ratios('')} FROM c WHERE tp + fn > 0) p GROUP BY class)
SELECT mi.class, {ratios('micro_')}, tp::BIGINT AS true_positive, fp::BIGINT AS false_positive, fn::BIGINT AS false_negative, tn::BIGINT AS true_negative, macro_precision, macro_recall, macro_f1 FROM mi LEFT JOIN ma ON ma.class = mi.class"""


_PAIRED = "(SELECT g.doc_id, g.label AS gold, p.label AS pred FROM v_gold g JOIN v_pred p ON g.doc_id = p.doc_id AND g.pos = p.pos)"


@_query(_duck_scores([(n, f"(gold = {k})", f"(pred = {k})") for k, n in enumerate(S.LABELS)], _PAIRED))
def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.label_metrics(V.gold(spark, sf_dir), V.pred(spark, sf_dir))


@_query(_duck_scores([("paragraph_boundary", "(gold IN (1, 2, 3))", "(pred IN (1, 2, 3))")], _PAIRED))
def paragraph_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.boundary_metrics(V.gold(spark, sf_dir), V.pred(spark, sf_dir))


@_query(f"SELECT sum(r) / sum(n)::DOUBLE AS micro, avg(r / n::DOUBLE) AS macro FROM (SELECT doc_id, sum((gold = pred)::INT) AS r, count(*) AS n FROM {_PAIRED} GROUP BY doc_id)")
def label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.label_accuracy(V.gold(spark, sf_dir), V.pred(spark, sf_dir))


_ACTIONS = [*S.LABELS, "ADDRESS"]


@_query(f"SELECT a.name AS gold, {', '.join(f'coalesce(sum((pred = {k})::INT), 0)::BIGINT AS {n}' for k, n in enumerate(_ACTIONS))} FROM (VALUES {', '.join(f'({k}, {chr(39)}{n}{chr(39)})' for k, n in enumerate(_ACTIONS))}) a(code, name) LEFT JOIN {_PAIRED} q ON q.gold = a.code GROUP BY a.name")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion(V.gold(spark, sf_dir), V.pred(spark, sf_dir))


_STRUCTURE_COUNTS = f"""{_duck_rel('v_gold', 'g')}, {_duck_rel('v_pred', 'p')}, pairs AS (SELECT doc_id, count(*) * (count(*) - 1) // 2 AS n FROM v_gold GROUP BY doc_id),
    joined AS (SELECT doc_id, coalesce(g.rel, -1) AS gold, coalesce(p.rel, -1) AS pred FROM g FULL JOIN p USING (doc_id, i, j))"""


def _structure_sql() -> str:
    counts = " UNION ALL ".join(f"SELECT pairs.doc_id, '{n}' AS class, count(*) FILTER (gold = {k} AND pred = {k}) AS tp, count(*) FILTER (gold <> {k} AND pred = {k}) AS fp, count(*) FILTER (gold = {k} AND pred <> {k}) AS fn, any_value(n) - count(*) FILTER (gold = {k} OR pred = {k}) AS tn FROM pairs LEFT JOIN joined ON joined.doc_id = pairs.doc_id GROUP BY pairs.doc_id" for k, n in enumerate(M.STRUCTURE))
    return f", {_STRUCTURE_COUNTS}{_duck_score_counts(counts)}"


@_query(_structure_sql())
def structure_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.structure_metrics(V.gold(spark, sf_dir), V.pred(spark, sf_dir))


@_query(f"{_structure_sql().rsplit('SELECT mi.class', 1)[0]} SELECT avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)) AS micro, avg(macro_f1) AS macro FROM mi LEFT JOIN ma ON ma.class = mi.class")
def average_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.average_f1(M.structure_metrics(V.gold(spark, sf_dir), V.pred(spark, sf_dir)))


_DEPTHS = """, step AS (SELECT doc_id, pos, l, CASE WHEN l = 3 THEN pp ELSE pv END AS src FROM (SELECT doc_id, pos, lag(pos) OVER w AS pv, lag(label) OVER w AS l, lag(pointer) OVER w AS pp FROM v_gold WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE pv IS NOT NULL),
    deep(doc_id, pos, level) AS (SELECT doc_id, min(pos), 0 FROM v_gold GROUP BY doc_id UNION ALL SELECT s.doc_id, s.pos, deep.level + (s.l = 2)::INT FROM deep JOIN step s ON s.doc_id = deep.doc_id AND s.src = deep.pos),
    depth_of AS (SELECT doc_id, (max(level) + 1)::INT AS max_depth FROM deep GROUP BY doc_id)"""


def _stats_sql() -> str:
    names = [n.lower() for n in S.LABELS]
    each = f"SELECT v.doc_id, count(*) AS n_text_blocks, any_value(max_depth) AS max_depth, {', '.join(f'sum((label = {k})::INT) AS count_{n}, sum((label = {k})::INT) / count(*)::DOUBLE AS ratio_{n}' for k, n in enumerate(names))} FROM v_gold v JOIN depth_of ON depth_of.doc_id = v.doc_id GROUP BY v.doc_id"
    columns = ["n_text_blocks", "max_depth", *[f"count_{n}" for n in names], *[f"ratio_{n}" for n in names]]
    return f"{_DEPTHS}, each_doc AS ({each}) " + " UNION ALL ".join(f"SELECT '{c}' AS measure, median({c}::DOUBLE) AS median, avg({c}::DOUBLE) AS mean, max({c})::DOUBLE AS max, min({c})::DOUBLE AS min FROM each_doc" for c in columns)


@_query(f"{_DEPTHS} SELECT * FROM depth_of")
def max_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.max_depth(V.gold(spark, sf_dir))


@_query(_stats_sql())
def data_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.statistics(V.gold(spark, sf_dir))


# models
@_query(f"SELECT cv_key, ((row_number() OVER (ORDER BY md5('{model.SEED}:' || cv_key::VARCHAR), cv_key) - 1) % 5)::INT AS fold FROM (SELECT DISTINCT doc_id AS cv_key FROM v_lines)")
def kfold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.folds(V.lines(spark, sf_dir).select(F.col("doc_id").alias("cv_key")))


def _model_input(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of all documents, and the gold labels of their lines."""
    blocks = V.text_blocks(spark, sf_dir)
    return blocks, V.gold(spark, sf_dir).join(blocks.select("doc_id", "pos"), ["doc_id", "pos"])


@_query()
def rf_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both forests fitted on the gold labels of all documents, and predictions for all of them."""
    blocks, gold = _model_input(spark, sf_dir)
    return model.predict(blocks, model.train(blocks, gold, "text_contract"))


@_query()
def k_fold_train_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for the documents of each of five folds by forests fitted on the other four."""
    return model.cross_predict(*_model_input(spark, sf_dir), "text_contract")


# other sources
def _cell_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hOCR page for each document, a span for each box of a line of its text."""
    b = V.boxes(spark, sf_dir)
    body = F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;")
    span = F.concat(F.lit('<span title="bbox '), F.concat_ws(" ", F.col("x0").cast("int").cast("string"), (1000 - F.col("y1")).cast("int").cast("string"), F.col("x1").cast("int").cast("string"), (1000 - F.col("y0")).cast("int").cast("string")), F.lit('">'), body, F.lit("</span>"))
    pages = b.select("doc_id", "page", "pos", span.alias("span")).groupBy("doc_id", "page").agg(F.array_join(F.expr("transform(sort_array(collect_list(struct(pos, span))), x -> x.span)"), "").alias("spans"))
    page = F.concat(F.lit('<div class="ocr_page"><table><tr><td title="bbox 0 0 612 1000">'), F.col("spans"), F.lit("</td></tr></table></div>"))
    return pages.withColumn("html", page).groupBy("doc_id").agg(F.array_join(F.expr("transform(sort_array(collect_list(struct(page, html))), x -> x.html)"), "").alias("html"))


@_query()
def hocr_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hocr.cell_blocks(hocr.spans(_cell_pages(spark, sf_dir), key="doc_id"))
