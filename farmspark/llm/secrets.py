"""Secret scan with corpus-wide ownership frequency.

Three patterns give the base spans; a fourth takes every long run of letters,
digits and key signs as a candidate.  The hash of each candidate's value is
counted over the whole corpus by the distinct repositories and owners that hold
it.  A value is

* an example, if three owners or ten repositories hold it: it is widely copied;
* live, if one owner holds it, in fewer repositories than that;
* shared otherwise (two owners, few repositories).

Live candidates of the fourth pattern are added to the base spans; base spans
always stay.

Only DataFrame functions: one scan takes matches and the lengths of the gaps
between them, everything after that works on rows of matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farmspark.llm.shared import doc_text, saved

_KEY = "A-Za-z0-9+/_=-"
#: kind: (pattern, group of the value, least length of the value)
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}+", 0, 24),
    # a whole run with a digit; that it has a letter as well is asked afterwards
    "owned": (rf"(?<![{_KEY}])(?=[A-Za-z+/_=-]*+[0-9])[{_KEY}]{{16,}}+", 0, 16),
}
BASE = ("assign", "access", "hex")
#: owners and repositories from which on a value counts as a copied example
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 10


def _found(text: Column, kind: str) -> Column:
    """Matches of a pattern in a text: their text, value and the gap before."""
    pattern, group, _ = KINDS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    both = F.arrays_zip(whole.alias("whole"), value.alias("value"), gaps.alias("gap"))
    # behind the last match there is one gap more
    return F.when(text.rlike(pattern), F.slice(both, F.lit(1), F.size(whole)))


def matches(docs: DataFrame, id_col: str, text_col: str, owner: Column, repository: Column | None) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, owner, repository (None: the row
    is one) and the matches of every kind (null for none)."""
    text = doc_text(text_col)
    row = F.monotonically_increasing_id()
    repository = row if repository is None else repository
    return docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
                       F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
                       *[_found(text, kind).alias(kind) for kind in KINDS])


def spans(found: DataFrame) -> DataFrame:
    """One row per candidate: row, kind, start, end (code points), value, owner, repository."""
    each = reduce(DataFrame.unionByName, [
        found.where(F.col(kind).isNotNull())
        .select("row", "owner", "repository", F.lit(kind).alias("kind"), F.lit(i).alias("rank"),
                F.lit(KINDS[kind][2]).alias("least"), F.posexplode(kind).alias("n", "m"))
        for i, kind in enumerate(KINDS)])
    before = Window.partitionBy("row", "kind").orderBy("n")
    length = F.length("m.whole")
    end = F.sum(F.col("m.gap") + length).over(before.rowsBetween(Window.unboundedPreceding, 0))
    return (each.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - length)
            .where(F.length("m.value") >= F.col("least"))
            .where((F.col("kind") != "owned") | F.col("m.value").rlike("[A-Za-z]"))
            .select("row", "kind", "rank", "start", "end", F.col("m.value").alias("value"), "owner", "repository"))


def ownership(candidates: DataFrame) -> DataFrame:
    """Per value hash: in how many rows, repositories and owners it is."""
    return (candidates.groupBy("value_hash", "owner", "repository").agg(F.count("*").alias("n"))
            .groupBy("value_hash").agg(F.sum("n").alias("n_found"), F.count_distinct("owner").alias("n_owners"),
                                       F.count_distinct("owner", "repository").alias("n_repositories")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None,
         repository: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``spans``, an array of (start, rank,
    kind, end, n_owners, n_repositories, live, example) by start, then kind.

    ``owner`` is the source and every row a repository of its own unless columns
    are given; a null owner is an owner of its own, and so is a null repository
    within its owner.  ``example``: at least EXAMPLE_OWNERS owners or
    EXAMPLE_REPOSITORIES repositories hold the value; ``live``: one owner does and
    it is no example; a shared value is neither.  Kind ``owned`` is added by the
    corpus: a live value outside all base spans.  Null texts are empty, rows
    without spans get an empty array, empty tables give no rows.
    """
    owner = F.col("source") if owner is None else owner
    found = saved(matches(docs, id_col, text_col, owner, repository), "matches")
    rows = saved(spans(found).withColumn("value_hash", F.sha2("value", 256)).drop("value"), "candidates")
    known = saved(ownership(rows), "ownership")
    copied = (F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_repositories") >= EXAMPLE_REPOSITORIES)
    told = rows.join(known, "value_hash").select(
        "row", "start", "rank", "kind", "end", "n_owners", "n_repositories", ((F.col("n_owners") == 1) & ~copied).alias("live"),
        copied.alias("example"))
    # a base span that begins at or before it and reaches into it, or begins inside it
    base = F.col("kind") != "owned"
    order = Window.partitionBy("row").orderBy("start", "rank")
    reach = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    following = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    free = (F.coalesce(reach, F.lit(0)) <= F.col("start")) & (following.isNull() | (following >= F.col("end")))
    kept = told.withColumn("free", free).where(base | (F.col("free") & F.col("live")))
    lists = kept.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
        "start", "rank", "kind", "end", "n_owners", "n_repositories", "live", "example"))).alias("spans"))
    return (found.select("row", "doc_id").join(lists, "row", "left")
            .select("doc_id", F.coalesce("spans", F.expr("cast(array() as " + lists.schema["spans"].dataType.simpleString() + ")")).alias("spans")))


def digests(scanned: DataFrame) -> DataFrame:
    """The columns of the scan's report from the spans of :func:`scan`."""
    def text(array: Column) -> Column:
        return F.array_join(F.transform(array, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(test) -> Column:
        return F.size(F.filter("spans", test)).cast("long")

    def of(kind):
        return lambda s: s["kind"] == kind

    return scanned.select(
        "doc_id", *[count(of(kind)).alias(f"n_{kind}") for kind in BASE],
        F.sha2(text(F.filter("spans", lambda s: s["kind"] != "owned")).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"), count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: s["example"]).alias("n_example"), count(lambda s: ~s["live"] & ~s["example"]).alias("n_shared"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["n_repositories"])), F.lit(0)).cast("long").alias("max_repositories"))
