"""Secrets in texts, told apart by who owns them: DataFrame functions only.

Fixed patterns find assignments, access keys and hex runs.  A wider pattern finds further tokens; of
these, a value counts as a live credential when it looks random and belongs to one owner and few
repositories in the whole corpus, while a value that several owners or many repositories have is a
copied example.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

#: Fixed patterns of the base rules (kind, pattern, group of the value, its least length), in their order.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: What a text must hold to be searched for each kind at all.
_HINT = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}",
    "owned": r"[A-Za-z0-9+/_=-]{20}",
}
_SEARCH = {"hex": r"[0-9a-f]{32,}", "owned": r"[A-Za-z0-9+/_=-]{20,}"}  # as the base rule, for runs of full length

SPAN = "struct<start:int,n:int,end:int,kind:string,value_hash:string>"


@dataclass(frozen=True)
class Settings:
    """A further token is a live credential with letters, a digit, ``distinct`` different characters,
    at most ``owners`` owners and at most ``repositories`` repositories.

    By texts, as mask() judges, copies of one text have one owner together, and a value in more than
    ``texts`` different texts is a copied example, whoever owns them.
    """

    distinct: int = 10
    owners: int = 1
    repositories: int = 100
    texts: int = 100


_KINDS = [(k, _SEARCH.get(k, p), g, n) for k, p, g, n in BASE] + [("owned", _SEARCH["owned"], 0, 20)]
#: Characters of a text's stretch in which spans meet that may overlap.
_CELL = 64
#: Characters that mask() rebuilds at a time.
_STRETCH = 1 << 16


def _marks(n: int, kind: str, pattern: str, group: int, least: int, s: Settings) -> Column:
    """All matches of a pattern in ``text``: of each, the piece of text that ends with it, as lengths, and its value's hash.

    \\G ties a piece to the one before, so that what follows the last match is read once; the pieces'
    lengths add up to the matches' ends.
    """
    pieces = F.when(F.col("text").rlike(_HINT[kind]), F.regexp_extract_all(F.col("text"), F.lit(rf"(?s)\G.*?(?:{pattern})"), F.lit(0)))

    def mark(piece: Column, i: Column) -> Column:
        value = F.regexp_extract(piece, pattern, group)
        fine = F.length(value) >= least
        if kind == "owned":
            fine &= value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= s.distinct)
        return F.struct(F.lit(n).alias("n"), i.alias("i"), F.length(piece).alias("piece"), F.length(F.regexp_extract(piece, pattern, 0)).alias("hit"),
                        F.when(fine, F.sha2(value, 256)).alias("value_hash"))

    return F.coalesce(F.transform(pieces, mark), F.array().cast("array<struct<n:int,i:int,piece:int,hit:int,value_hash:string>>"))


def _spans(marked: DataFrame) -> DataFrame:
    """(row, n, start, end, value_hash) of rows (row, marks): base spans, and further ones that overlap none, in code points."""
    marks = marked.select("row", F.inline("marks"))
    upto = Window.partitionBy("row", "n").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = marks.withColumn("end", F.sum("piece").over(upto).cast("int")).where("value_hash IS NOT NULL")
    spans = stored(ends.select("row", "n", (F.col("end") - F.col("hit")).alias("start"), "end", "value_hash"), "spans")
    base, more = spans.where(F.col("n") < len(BASE)), spans.where(F.col("n") == len(BASE))
    cells = F.explode(F.expr(f"sequence(start div {_CELL}, (end - 1) div {_CELL})")).alias("cell")
    taken = base.select("row", cells, F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    met = more.select("row", cells, "start", "end").join(taken, ["row", "cell"]).where("b_start < end AND start < b_end").select("row", "start").distinct()
    return base.unionByName(more.join(met, ["row", "start"], "left_anti").select(*base.columns))


def _line(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))


def ownership(values: DataFrame) -> DataFrame:
    """(value_hash, n_owners, n_repositories, n) of candidates (value_hash, owner, repository).

    Copies within a task are combined before each shuffle, so a value that a third of all rows hold
    arrives as a row per task and owner.
    """
    each = values.groupBy("value_hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    per_owner = each.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("n_repositories"), F.sum("n").alias("n"))
    return per_owner.groupBy("value_hash").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("n_repositories").alias("n_repositories"), F.sum("n").alias("n"))


def ownership_by_text(values: DataFrame) -> DataFrame:
    """(value_hash, n_owners, n_texts) of candidates (value_hash, owner, text_hash): the copies of a text
    have one owner together, the smallest."""
    each = values.groupBy("value_hash", "text_hash").agg(F.min("owner").alias("owner"))
    per_owner = each.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("n_texts"))
    return per_owner.groupBy("value_hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n_texts").alias("n_texts"))


def scan(docs: DataFrame, s: Settings = Settings(), owner: str = "source", by_text: bool = False) -> DataFrame:
    """(doc_id, text_hash, base, spans, n_assign, n_access, n_hex, n_live, n_copied), a row per document.

    base and spans hold (start, n, end, kind, value_hash) in the order of start and kind; spans are the
    base ones and, as kind "owned", the further tokens whose value has at most ``owners`` owners and
    ``repositories`` repositories.  n_live counts base and further spans with such values, n_copied the others.
    A document is a repository, its ``owner`` column names the owner; a null owner is one owner.  With
    ``by_text``, values are judged by owners of different texts and by the number of these.

    A null text is empty; repeated rows are scanned each for itself and count as one repository; a
    null doc_id stays null.  An empty table gives no rows; other columns are ignored.
    """
    columns = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"))
    marks = F.concat(*(_marks(i, *kind, s) for i, kind in enumerate(_KINDS)))
    found = columns.select("doc_id", "owner", F.xxhash64("text").alias("text_hash"), marks.alias("marks"))
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "secrets")
    who = found.where("size(marks) > 0").select("row", "owner", "text_hash", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("repository"))
    spans = stored(_spans(found.where("size(marks) > 0")), "candidates")
    values = spans.select("row", "value_hash").distinct().join(who, "row")
    few = F.col("n_owners") <= s.owners
    judged = ownership_by_text(values).select("value_hash", (few & (F.col("n_texts") <= s.texts)).alias("live")) if by_text else (
        ownership(values).select("value_hash", (few & (F.col("n_repositories") <= s.repositories)).alias("live")))
    known = stored(judged.where("live"), "owners")
    names = F.array(*[F.lit(k) for k, *_ in _KINDS])
    span = F.struct("start", "n", "end", F.element_at(names, F.col("n") + 1).alias("kind"), "value_hash")
    named = spans.join(known, "value_hash", "left").select("row", "n", span.alias("span"), F.coalesce("live", F.lit(False)).alias("live"))
    is_base, none = F.col("n") < len(BASE), F.array().cast(f"array<{SPAN}>")
    per_row = named.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(is_base, F.col("span")))).alias("base"),
        F.array_sort(F.collect_list(F.when(is_base | F.col("live"), F.col("span")))).alias("spans"),
        *(F.count_if(F.col("n") == i).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)),
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_copied"))
    counts = [*(f"n_{k}" for k, *_ in BASE), "n_live", "n_copied"]
    return found.select("row", "doc_id", "text_hash").join(per_row, "row", "left").select(
        "doc_id", "text_hash", *(F.coalesce(c, none).alias(c) for c in ("base", "spans")), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract from the rows of scan()."""
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_line(F.col("base")), 256).alias("base_sha256"),
        _line(F.col("spans")).alias("spans"), "n_live", "n_copied")


def mask(docs: DataFrame, s: Settings = Settings(), owner: str = "source", sign: str = "[SECRET]") -> DataFrame:
    """documents with every found span replaced by ``sign`` and n_chars set anew; other texts as they are.

    Owners are counted by text: a token stays a secret when its document has a copy in another source,
    and is none when one source has it in more than ``texts`` texts.
    """
    own = {k: f"{k}_{uuid.uuid4().hex}" for k in ("doc_id", "text_hash", "spans", "hash")}
    found = scan(docs, s, owner, by_text=True).where("size(spans) > 0").select(*(F.col(k).alias(own[k]) for k in ("doc_id", "text_hash", "spans")))
    # Rows of one id and text have the same base spans, and the same further ones but for their owners.
    found = found.groupBy(own["doc_id"], own["text_hash"]).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(own["spans"])))).alias(own["spans"]))
    keyed = docs.withColumn(own["hash"], F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    joined = keyed.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(own["doc_id"])) & (F.col(own["hash"]) == F.col(own["text_hash"])), "left")
    # Stretch by stretch, so that a long text of many spans is not copied as a whole for each of them.
    rebuilt = F.expr(
        f"array_join(transform(regexp_extract_all(text, '(?s).{{1,{_STRETCH}}}', 0), (p, i) -> aggregate("
        f"filter({own['spans']}, x -> x.end > i * {_STRETCH} AND x.start < (i + 1) * {_STRETCH}), named_struct('made', '', 'at', i * {_STRETCH}), "
        f"(a, x) -> named_struct('made', if(x.start >= a.at, concat(a.made, substring(p, a.at - i * {_STRETCH} + 1, x.start - a.at), '{sign}'), a.made), "
        f"'at', greatest(a.at, x.end)), a -> concat(a.made, substring(p, a.at - i * {_STRETCH} + 1)))), '')")
    plain = F.col(own["spans"]).isNull()
    changed = {"text": F.when(plain, F.col("text")).otherwise(rebuilt)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(plain, F.col("n_chars")).otherwise(F.length(changed["text"]).cast("long"))
    return joined.withColumns(changed).select(*docs.columns)


def duckdb_sql(s: Settings = Settings()) -> str:
    """The same rows in DuckDB's SQL, as a check."""
    either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    words = "|".join(either(w) for w in ("password", "passwd", "secret", "token"))
    api = "".join(either(c) for c in "api") + "_?" + either("key")
    patterns = {
        "assign": (rf"({words}|{api})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)".replace("'", "''"), 2, 8),
        "access": (BASE[1][1], 0, 16), "hex": (BASE[2][1], 0, 32), "owned": (r"[A-Za-z0-9+/_=-]+", 0, 20),
    }
    parts = " UNION ALL ".join(
        f"SELECT row, {n} AS n, '{k}' AS kind, {least} AS least, i, l[i] AS piece, regexp_extract(l[i], '{p}') AS hit, regexp_extract(l[i], '{p}', {g}) AS value "
        f"FROM (SELECT row, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT row, regexp_extract_all(text, '(?s).*?(?:{p})') AS l FROM d))"
        for n, (k, (p, g, least)) in enumerate(patterns.items()))
    line = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, n) {f}, '')"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner FROM documents),
pieces AS MATERIALIZED ({parts}),
placed AS (SELECT *, sum(length(piece)) OVER (PARTITION BY row, n ORDER BY i) AS e0 FROM pieces),
found AS MATERIALIZED (
    SELECT row, n, kind, value, CAST(e0 - length(hit) AS INTEGER) AS s, CAST(e0 AS INTEGER) AS e FROM placed
    WHERE length(value) >= least AND (kind <> 'owned' OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
        AND len(list_distinct(string_split(value, ''))) >= {s.distinct}))),
candidates AS MATERIALIZED (
    SELECT * FROM found f WHERE kind <> 'owned' OR NOT EXISTS (
        SELECT 1 FROM found b WHERE b.row = f.row AND b.kind <> 'owned' AND b.s < f.e AND f.s < b.e)),
owners AS (SELECT value, count(DISTINCT owner) AS n_owners, count(DISTINCT (owner, coalesce(CAST(doc_id AS VARCHAR), ''))) AS n_repositories
    FROM candidates JOIN d USING (row) GROUP BY value),
spans AS (SELECT c.*, n_owners <= {s.owners} AND n_repositories <= {s.repositories} AS live FROM candidates c JOIN owners USING (value)),
per_row AS (
    SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        {line.format(f="FILTER (kind <> 'owned')")} AS base, {line.format(f="FILTER (kind <> 'owned' OR live)")} AS spans,
        count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied
    FROM spans GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(p.spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN per_row p USING (row)
"""
