"""Site-relative line frequency: lines that stand on too large a share of a host's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexvane.llm.common import SPACES, broadcast_if_small, join_hot, materialise, table

RATIO = 0.1
#: A line has to repeat: a page alone on its host keeps all of its lines.
REPEATS = 2


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(SPACES))


def _key(bare: Column) -> Column:
    """A line without white space at its ends, as two 64-bit hashes."""
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(1), bare).alias("b"))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO) -> DataFrame:
    """(host, lines): hashes of the lines on more than ratio of a host's pages, and on REPEATS pages or more.

    A page counts once for a line. A host has at most (mean lines of a page) / ratio such lines, however many pages. Counts
    are combined before the shuffle, so a line or host that most pages share is no large group.
    """
    host_name = F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host")
    pages = docs.groupBy(host_name).agg(F.count("*").alias("pages"))
    keys = F.transform(F.array_distinct(F.filter(F.transform(_lines(F.col(text)), _bare), lambda x: x != "")), _key)
    counted = docs.select(host_name, F.explode_outer(keys).alias("line")).filter("line is not null").groupBy("host", "line.a", "line.b").agg(F.count("*").alias("n")).filter(F.col("n") >= REPEATS)
    often = counted.join(broadcast_if_small(pages, 100_000), "host").filter(F.col("n") > F.lit(ratio) * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list(F.struct("a", "b")).alias("lines"))


def _slots(lines: Column) -> Column:
    """A host's lines, dealt by their hashes to about sqrt(lines) slots, so that a look-up compares with about sqrt(lines) of them."""
    n = F.ceil(F.sqrt(F.size(lines))).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.filter(lines, lambda x: F.pmod(x["a"], n) == i))


def _found(line: Column, slots: Column) -> Column:
    """Whether the line, without white space at its ends, is in the slots; the array of one key only makes the key once."""
    at = lambda key: F.pmod(key["a"], F.size(slots)).cast("int")
    return F.exists(F.array(_key(_bare(line))), lambda key: F.array_contains(F.get(slots, at(key)), key))


def drop_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, max_broadcast: int = 500_000) -> DataFrame:
    """docs with boilerplate lines cut out of text, and n_lines and n_dropped (long; columns of these names are replaced).

    Lines are \\n-split and compared without white space at their ends; blank lines stay and count for nothing. Null texts
    stay null; a null host is a host of that kind. Lines on one page alone stay. A text may become empty. Rows that repeat are
    pages of their own; an empty table gives an empty one; a text of any length counts whole, and other columns may have any names.
    max_broadcast: the most lines of all hosts that are broadcast.
    """
    found = materialise(boilerplate(docs, host, text, ratio), "boilerplate")
    lines = found.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    found = found.select("host", _slots(F.col("lines")).alias("lines"))
    inner = {c: f"column_{i}" for i, c in enumerate(docs.columns)}  # so that no column name can clash
    body, bad = F.col(inner[text]), F.col("lines")
    rows = docs.toDF(*inner.values()).withColumn("host", F.coalesce(F.col(inner[host]).cast("string"), F.lit("")))
    rows = join_hot(rows, found, "host", body, max_broadcast if lines <= max_broadcast else -1)
    parts = F.split(body, "\n")
    stay = F.filter(parts, lambda x: (_bare(x) == "") | ~_found(x, bad))
    rest = F.when(body.isNull() | bad.isNull(), body).otherwise(F.array_join(stay, "\n"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    dropped = F.when(bad.isNull() | body.isNull(), F.lit(0)).otherwise(F.size(parts) - F.size(stay)).cast("long").alias("n_dropped")
    out = rows.select(*[rest.alias("rest") if c == text else F.col(inner[c]) for c in columns], F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n"), dropped)
    return out.toDF(*columns, "n_lines", "n_dropped")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "n_lines", "n_dropped")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents without the boilerplate lines of their source; n_chars follows the text. Every row stays, repeated ones and those left empty too."""
    out = drop_lines(docs.select("source", "text", F.struct("*").alias("_row")))  # whole rows, so that no column name can clash
    changed = F.col("n_dropped") > 0
    row = F.col("_row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars")))
    return out.select(row.alias("_row")).select("_row.*")


ORACLE = f"""
with lines as (select rowid as r, doc_id, coalesce(source, '') as host, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as at from documents_rows),
bare as (select *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as b from lines),
pages as (select coalesce(source, '') as host, count(*) as pages from documents_rows group by 1),
bad as (select b.host, b.b from bare b join pages p on b.host = p.host where b.b <> '' group by b.host, b.b, p.pages having count(distinct b.r) >= {REPEATS} and count(distinct b.r) > cast({RATIO} as double) * p.pages),
cut as (select l.r, count(*) as n_lines, count(x.b) as n_dropped, coalesce(string_agg(l.line, chr(10) order by l.at) filter (where x.b is null), '') as text from bare l left join bad x on l.host = x.host and l.b = x.b group by l.r)
select d.doc_id, d.source, case when d.text is null then null else c.text end as text, cast(coalesce(c.n_lines, 0) as bigint) as n_lines, cast(coalesce(c.n_dropped, 0) as bigint) as n_dropped
from documents_rows d left join cut c on d.rowid = c.r
""".replace("with lines", "with documents_rows as (select row_number() over () as rowid, * from documents),\nlines")
