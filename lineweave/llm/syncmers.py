"""Operator 6, document fingerprints: closed syncmers over words, in DataFrame and SQL functions only.

A k-mer is K words; its inner substrings are its runs of S words. It is a closed syncmer if the run with the smallest hash
is its first or its last one: that depends on the k-mer alone, so texts choose the same k-mers wherever they share
K words, and an edit changes none beyond it. A fingerprint is the hashes of all of a text's syncmers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, prepare, table

#: Words of a k-mer, words of an inner run, hashes of a fingerprint at most (None: all); a word has WORD_CHARS characters at most, longer ones are cut.
K, S, KEPT, WORD_CHARS = 5, 2, None, 16
WORD = rf"[^\x20\x09-\x0D]{{1,{WORD_CHARS}}}"


def word_hashes(text: Column) -> Column:
    """xxhash64 of each word, A-Z as a-z; null as empty."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def _runs(hashes: Column) -> Column:
    """Hashes of the runs of S = 2 words."""
    n = F.size(hashes)
    return F.when(n >= S, F.zip_with(F.slice(hashes, F.lit(1), n - 1), F.slice(hashes, F.lit(2), n - 1), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<long>"))


def _syncmer(runs: str, i: str) -> str:
    """SQL: the hash of the k-mer at run i (from 0) if it is a closed syncmer, else null. A k-mer is K - S + 1 = 4 runs."""
    at = [f"{runs}[{i} + {d}]" for d in range(K - S + 1)]
    return f"IF(least({', '.join(at)}) IN ({at[0]}, {at[-1]}), xxhash64({at[0]}, {at[2]}, {at[3]}), NULL)"


def with_anchors(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the column `name`: array of (position, hash) of the text's closed syncmers; position: words from 0.

    Equal (hash) anchors of two texts give the shift between their positions, whatever stands elsewhere.
    """
    runs = f"{name}__runs"
    df = df.withColumn(runs, _runs(word_hashes(F.col(text))))
    made = f"filter(transform(IF(size({runs}) >= {K - S + 1}, sequence(0, size({runs}) - {K - S + 1}), cast(array() AS array<int>)), i -> named_struct('position', i, 'hash', {_syncmer(runs, 'i')})), x -> x.hash IS NOT NULL)"
    return df.withColumn(name, F.expr(made)).drop(runs)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the column `name`: the distinct hashes (remainders by 2 ** 31) of all of the text's syncmers, ascending.

    A text without a syncmer that has words (fewer than K, mostly) has the hash of all its words; one without words none.
    """
    words, runs = f"{name}__words", f"{name}__runs"
    df = df.withColumn(words, word_hashes(F.col(text))).withColumn(runs, _runs(F.col(words)))
    made = f"filter(transform(IF(size({runs}) >= {K - S + 1}, sequence(0, size({runs}) - {K - S + 1}), cast(array() AS array<int>)), i -> {_syncmer(runs, 'i')}), x -> x IS NOT NULL)"
    df = df.withColumn(name, F.expr(f"array_sort(array_distinct(transform({made}, x -> cast(x % 2147483648 AS int))))"))
    whole = F.array((F.xxhash64(words) % 2147483648).cast("int"))
    return df.withColumn(name, F.when((F.size(name) == 0) & (F.size(words) > 0), whole).otherwise(F.col(name))).drop(words, runs)


def hexed(fingerprint: Column) -> Column:
    """Eight lower-case hex digits for each hash."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two fingerprints, that is, of the texts' sets of syncmers; 1 if neither has any."""
    shared = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b) - shared
    return F.when(both == 0, F.lit(1.0)).otherwise(shared / both)


def next_ids(docs: DataFrame) -> DataFrame:
    """(id, next): each distinct non-null doc_id of docs and the next greater one; after the greatest the smallest.

    Ids are sorted over all partitions and numbered within each; a number is joined with the one before it, and only the
    first and last id of each partition are compared beyond it, so no task sees more than its share.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("id")).where("id IS NOT NULL").distinct()
    # the low 33 bits of the number count the rows of a partition, the rest is the partition's number
    ordered = cut(ids.orderBy("id").withColumn("at", F.monotonically_increasing_id()))
    after = ordered.select(F.col("id").alias("next"), (F.col("at") - 1).alias("at"))
    inner = ordered.join(after, "at", "left").select("id", "at", "next")
    inner = cut(inner)
    part = F.shiftright("at", 33)
    edges = ordered.groupBy(part.alias("part")).agg(F.min("id").alias("least"), F.max("id").alias("id"))
    # a row for each partition that has ids
    chain = edges.selectExpr("id", "least", "lead(least) OVER (ORDER BY part) AS follows", "first(least) OVER (ORDER BY part) AS first")
    ends = chain.select("id", F.coalesce("follows", "first").alias("next"))
    return inner.where("next IS NOT NULL").select("id", "next").unionByName(inner.where("next IS NULL").select("id").join(ends, "id"))


def edited(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A row for each row of docs. Null text: empty. The next document of an id is that of the next greater id; of rows that
    repeat an id, the one whose text has the smallest MD5 is the next of the id before. A null id has no next document:
    its text loses its last quarter and near_next is 0. A single document is its own next. Other columns: ignored.
    Texts are shuffled by id once, and of each next document only the characters that are asked for.
    """
    prepare(docs.sparkSession)
    all_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sizes = all_docs.select("doc_id", F.length("text").alias("n_chars"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("md5")).where("doc_id IS NOT NULL")
    light = cut(sizes.groupBy("doc_id").agg(F.min("md5").alias("md5"), F.sort_array(F.collect_set((F.col("n_chars") / 4).cast("int"))).alias("quarters")))
    follow = next_ids(light)
    # asked(next, md5 of its text, by whom, how many characters)
    asked = follow.join(light.select(F.col("doc_id").alias("id"), "quarters"), "id").join(light.select(F.col("doc_id").alias("next"), F.col("md5").alias("next_md5")), "next")
    # both joins are on doc_id and take the same columns, so that one exchange of the texts serves them; fingerprints are
    # taken behind it, as lambda functions before it would make its two uses look different to the planner
    # (so would an alias of the same name, which is dropped from one of them)
    plain = all_docs.where("doc_id IS NOT NULL").withColumnRenamed("doc_id", "this_id")
    heads = plain.join(asked, plain["this_id"] == asked["next"])
    this = F.unhex(F.md5(F.col("text").cast("binary"))) == F.col("next_md5")  # no filter, which would become a second join key
    heads = with_fingerprint(heads.select("id", "quarters", F.when(this, F.col("text")).alias("text")), "text", "next_fingerprint")
    heads = heads.select(F.col("id").alias("to"), F.when(F.col("text").isNotNull(), F.col("next_fingerprint")).alias("next_fingerprint"), F.when(F.col("text").isNotNull(), F.expr("transform(quarters, q -> named_struct('q', q, 'head', substring(text, 1, q)))")).alias("heads"))
    heads = heads.groupBy("to").agg(F.max("next_fingerprint").alias("next_fingerprint"), F.max("heads").alias("heads"))
    both = plain.join(heads, plain["this_id"] == heads["to"], "left").select(F.col("this_id").alias("doc_id"), "text", "next_fingerprint", "heads")
    both = both.unionByName(all_docs.where("doc_id IS NULL"), allowMissingColumns=True)
    both = with_fingerprint(both, "text", "fingerprint").withColumn("n_chars", F.length("text").cast("long"))
    head = F.expr("coalesce(filter(heads, x -> x.q = n_chars div 4)[0].head, '')")
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 4 AS int))"), head))
    both = with_fingerprint(both.select("doc_id", "n_chars", "fingerprint", "next_fingerprint", "edited", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")), "edited", "edited_fingerprint")
    return both.select(
        "doc_id", "n_chars", "edited_sha256", hexed(F.col("fingerprint")).alias("fingerprint"), hexed(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), F.coalesce(likeness(F.col("fingerprint"), F.col("next_fingerprint")), F.lit(0.0)).alias("near_next"),
    )


def op6_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return edited(table(spark, sf_dir, "documents"))
