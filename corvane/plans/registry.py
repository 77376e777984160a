"""Where queries register with their SQL, and the views of the tables that several of them read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a function of a session and a folder under its name, with SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_tokens(column: str) -> str:
    """``tokens`` of ``functions.text`` as SQL."""
    plain = rf"regexp_replace(regexp_replace(lower(coalesce({column}, '')), '::|[/\-.]', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]', '', 'g')"
    return rf"list_filter(string_split_regex({plain}, '\s+'), lambda t: t <> '')"


#: Kinds of the rows of ``symbols``, by the remainder of a number.
KINDS = ("function", "struct", "trait", "method", "field", "local", "impl", "enum")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the symbols of a code base: a path by type and brand, a name, a kind, a span of lines."""
    part, key = read(spark, sf_dir, "part"), F.col("p_partkey")
    name, brand, group = F.replace("p_name", F.lit(" "), F.lit("_")), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lower("p_type")
    return part.select(
        F.concat(F.lit("sym:"), key.cast("string")).alias("symbol_id"),
        key.alias("ord"),
        name.alias("name"),
        F.concat_ws("::", group, brand, name).alias("qualified_name"),
        F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_size") % 8 + 1).cast("int")).alias("kind"),
        F.concat(F.when(key % 17 == 0, "tests/").when(key % 13 == 0, "web/dist/").otherwise("src/"), group, F.lit("/"), brand, F.lit(".rs")).alias("path"),
        group.alias("package"),
        F.when(key % 3 == 0, "pub").otherwise("private").alias("visibility"),
        (key % 97 * 10 + 1).cast("int").alias("start_line"),
        (key % 97 * 10 + 1 + F.col("p_size")).cast("int").alias("end_line"),
    )


SYMBOLS = f"""select 'sym:' || p_partkey symbol_id, p_partkey ord, replace(p_name, ' ', '_') as name,
 lower(p_type) || '::' || lower(replace(p_brand, '#', '')) || '::' || replace(p_name, ' ', '_') qualified_name,
 {list(KINDS)}[(p_size % 8 + 1)::int] kind, case when p_partkey % 17 = 0 then 'tests/' when p_partkey % 13 = 0 then 'web/dist/' else 'src/' end
 || lower(p_type) || '/' || lower(replace(p_brand, '#', '')) || '.rs' path, lower(p_type) package,
 case when p_partkey % 3 = 0 then 'pub' else 'private' end visibility,
 (p_partkey % 97 * 10 + 1)::int start_line, (p_partkey % 97 * 10 + 1 + p_size)::int end_line from part"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as statements of containers (users) in their order; each names a key, and purchases and signups write it."""
    w = read(spark, sf_dir, "events")
    key = F.get_json_object("props", "$.k").cast("long") % 10
    return w.select(F.col("event_id").alias("statement"), F.col("user_id").alias("container"), "ts", F.col("event_type").alias("kind"), key.alias("key"), F.col("event_type").isin("purchase", "signup").alias("writes"), F.col("value"))


STATEMENTS = """select event_id statement, user_id container, ts, event_type kind, (props->>'$.k')::bigint % 10 as key,
 event_type in ('purchase', 'signup') writes, value from events"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: the URL without scheme, query and fragment is the path."""
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), T.url_path(F.col("url")).alias("path"), F.length("html").cast("long").alias("size"))


FILES = r"""select page_id file_id, regexp_replace(regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g'), '/+$', '') path, length(html)::bigint size from pages"""
