"""From fetched feed payloads to Bronze rows.

Fetching is not a Spark job: a landing table holds what came back, one row per attempt
``(source_id, cycle, attempt, payload, error)``. Everything after that is DataFrame work over
all sources and cycles at once; a source that failed or does not parse is set aside with its
reason and never fails the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pressgauge.functions import identity, subjects
from pressgauge.functions import vocabulary as V
from pressgauge.operators.joins import left_join_present
from pressgauge.operators.picks import first_by
from pressgauge.schemas import FEED_CONFIG
from pressgauge.session import scratch_path, scratch_scope, staged
from pressgauge.sources.pages import MIN_ARTICLE_CHARS

# Accepted settings and the feed text length below which a page is opened.
FORMATS = ("rss", "worldbank-json")
BODY_MODES = ("feed", "article", "article_always")
SHORT_FEED_CHARS = 300
DEFAULT_LIMIT = 100
DEFAULT_RETRIES = 2

_KEYS = ["source_id", "cycle"]


# -- configuration ----------------------------------------------------------------------------


def feed_configs(spark: SparkSession, path: str) -> DataFrame:
    """Configured sources with their place in the file, defaults filled in and checked."""
    text = spark.read.text(path, wholetext=True)
    listed = text.select(
        F.posexplode(F.from_json("value", f"array<struct<{_ddl_fields()}>>")).alias("place", "c")
    )
    return checked_configs(listed.select("place", "c.*"))


def _ddl_fields() -> str:
    return FEED_CONFIG.replace(" string", ":string").replace(" int", ":int")


def checked_configs(configs: DataFrame) -> DataFrame:
    """Defaults for what is left out; a setting outside its list stops the job."""

    def one_of(column: str, allowed: tuple[str, ...]) -> Column:
        bad = F.concat(F.lit(f"unknown {column} "), F.coalesce(F.col(column), F.lit("null")))
        return F.when(F.col(column).isin(*allowed), F.col(column)).otherwise(F.raise_error(bad))

    filled = configs.withColumns(
        {
            "limit": F.coalesce("limit", F.lit(DEFAULT_LIMIT)),
            "format": F.coalesce("format", F.lit("rss")),
            "body_extraction": F.coalesce("body_extraction", F.lit("feed")),
        }
    )
    low = F.raise_error(F.lit("a feed limit is at least 1"))
    return filled.withColumns(
        {
            "axis": one_of("axis", V.AXES),
            "format": one_of("format", FORMATS),
            "body_extraction": one_of("body_extraction", BODY_MODES),
            "limit": F.when(F.col("limit") >= 1, F.col("limit")).otherwise(low.cast("int")),
        }
    )


# -- acquisition ------------------------------------------------------------------------------


def acquired(attempts: DataFrame, retries: int = DEFAULT_RETRIES) -> tuple[DataFrame, DataFrame]:
    """First successful payload per source and cycle, and the sources that never answered."""
    tried = attempts.filter(F.col("attempt") <= max(1, retries + 1))
    answered = first_by(tried.filter(F.col("payload").isNotNull()), _KEYS, [F.col("attempt")])
    lost = tried.join(answered.select(*_KEYS), _KEYS, "left_anti")
    failures = lost.groupBy(*_KEYS).agg(
        F.concat(
            F.lit("failed after retries: "),
            F.coalesce(F.max_by("error", "attempt"), F.lit("no reason given")),
        ).alias("reason")
    )
    return answered.select(*_KEYS, "payload"), failures


# -- parsing ----------------------------------------------------------------------------------

_TEXT = "array<struct<_VALUE: string>>"
_ENTRY = (
    f"struct<title: {_TEXT}, encoded: {_TEXT}, content: {_TEXT}, description: {_TEXT}, "
    f"summary: {_TEXT}, views: {_TEXT}, viewcount: {_TEXT}, "
    "link: array<struct<_VALUE: string, _rel: string, _href: string>>>"
)
# Feeds spell this tag with and without a capital; the schema knows the plain spelling.
_VIEW_TAG = r"(</?(?:\w+:)?)viewCount\b"
_FEED = (
    f"channel struct<item: array<{_ENTRY}>>, item array<{_ENTRY}>, entry array<{_ENTRY}>, "
    "_corrupt_record string"
)


def _text(*fields: str) -> Column:
    """First non-empty text of the named children, each read from its first occurrence."""

    def first(field: str) -> Column:
        value = F.try_element_at(F.col(f"e.{field}"), F.lit(1))["_VALUE"]
        return F.nullif(subjects.collapse_ends(value), F.lit(""))

    return F.coalesce(*[first(f) for f in fields])


def _link() -> Column:
    """A link's text, or the address of an alternate link; failing both, any address."""

    def text(link: Column) -> Column:
        return F.nullif(subjects.collapse_ends(link["_VALUE"]), F.lit(""))

    def address(link: Column) -> Column:
        return F.nullif(link["_href"], F.lit(""))

    def direct(link: Column) -> Column:
        rel = F.coalesce(F.nullif(link["_rel"], F.lit("")), F.lit("alternate"))
        return F.coalesce(text(link), F.when(rel == "alternate", address(link)))

    links = F.col("e.link")
    straight = F.array_compact(F.transform(links, direct))
    any_address = F.array_compact(F.transform(links, address))
    return F.coalesce(
        F.try_element_at(straight, F.lit(1)), F.try_element_at(any_address, F.lit(1))
    )


def parse_feeds(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of RSS, RDF and Atom documents in document order, and the malformed ones."""
    return _apart(_feed_entries(payloads))


def _apart(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries, and the payloads that stand for themselves with a reason."""
    return parsed.filter(F.col("reason").isNull()).drop("reason"), parsed.filter(F.col("reason").isNotNull()).select(*_KEYS, "reason")


def _feed_entries(payloads: DataFrame) -> DataFrame:
    """The entries, with a null ``reason``, and one row for each malformed document: a single reading finds both."""
    options = {
        "ignoreNamespace": "true",
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": "_corrupt_record",
    }
    text = F.regexp_replace(F.col("payload").cast("string"), _VIEW_TAG, "$1viewcount")
    read = payloads.select(*_KEYS, F.from_xml(text, _FEED, options).alias("doc"))
    empty = F.array().cast(f"array<{_ENTRY}>")
    entries = F.concat(
        *[F.coalesce(f"doc.{part}", empty) for part in ("channel.item", "item", "entry")]
    )
    bad = F.col("doc").isNull() | F.col("doc._corrupt_record").isNotNull()
    reason = F.when(bad, F.lit("malformed feed"))
    none = F.array(F.lit(None).cast(_ENTRY))
    return (
        read.select(*_KEYS, reason.alias("reason"), F.posexplode(F.when(bad, none).otherwise(entries)).alias("place", "e"))
        .select(
            *_KEYS,
            "place",
            F.coalesce(_text("title"), F.lit(V.UNTITLED)).alias("title"),
            _link().alias("url"),
            F.coalesce(_text("encoded", "content", "description", "summary"), F.lit("")).alias(
                "body"
            ),
            F.coalesce(_text("views", "viewcount").try_cast("bigint"), F.lit(0)).alias(
                "view_count"
            ),
            "reason",
        )
        .filter(F.col("url").isNotNull() | F.col("reason").isNotNull())
    )


def _unwrapped(doc: Column, field: str) -> Column:
    """A text field of the search reply, plain or wrapped as ``{"cdata!": text}``."""
    value = F.try_variant_get(doc, f"$.{field}", "variant")
    plain = F.when(
        F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")
    )
    inner = F.try_variant_get(doc, f"$.{field}['cdata!']", "variant")
    wrapped = F.when(
        F.schema_of_variant(inner) == "STRING", F.try_variant_get(inner, "$", "string")
    )
    return F.nullif(subjects.collapse_ends(F.coalesce(plain, wrapped)), F.lit(""))


def parse_search_replies(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of a search reply in reply order; the API gives no view counts.

    ``documents`` is read as a map, which keeps the order of the text; entries that are no
    object or name no address are left out.
    """
    return _apart(_search_entries(payloads))


def _search_entries(payloads: DataFrame) -> DataFrame:
    """As ``_feed_entries``, of search replies."""
    read = payloads.select(
        *_KEYS,
        F.from_json(F.col("payload").cast("string"), "documents map<string, string>")[
            "documents"
        ].alias("documents"),
    )
    bad = F.col("documents").isNull()
    texts = F.when(bad, F.array(F.lit(None).cast("string"))).otherwise(F.map_values("documents"))
    listed = (
        read.select(*_KEYS, F.when(bad, F.lit("malformed worldbank-json response")).alias("reason"), F.posexplode(texts).alias("place", "text"))
        .withColumn("doc", F.try_parse_json("text"))
        .filter(F.startswith(F.schema_of_variant("doc"), F.lit("OBJECT")) | F.col("reason").isNotNull())
    )
    return listed.select(
        *_KEYS,
        "place",
        F.coalesce(_unwrapped(F.col("doc"), "title"), F.lit(V.UNTITLED)).alias("title"),
        _unwrapped(F.col("doc"), "url").alias("url"),
        F.coalesce(
            _unwrapped(F.col("doc"), "content"), _unwrapped(F.col("doc"), "descr"), F.lit("")
        ).alias("body"),
        F.lit(0).cast("bigint").alias("view_count"),
        "reason",
    ).filter(F.col("url").isNotNull() | F.col("reason").isNotNull())


# -- ranking, bodies, duplicates --------------------------------------------------------------


def ranked(articles: DataFrame, configs: DataFrame) -> DataFrame:
    """The source's leading entries by views; equal views keep the feed's own order. Rows with a ``reason``, if
    there is such a column, are no entries: they are passed on as they are."""
    reason = F.col("reason") if "reason" in articles.columns else F.lit(None)
    order = W.partitionBy(*_KEYS, reason.isNull()).orderBy(F.col("view_count").desc(), F.col("place"))
    settings = configs.select(
        F.col("source_id").alias("config_source"), "axis", "limit", "body_extraction", F.col("place").alias("config_place")
    )
    return (
        articles.withColumn("rank", F.row_number().over(order).cast("bigint"))
        .join(settings, reason.isNull() & (F.col("source_id") == F.col("config_source")), "left")
        .filter((F.col("rank") <= F.col("limit")) | reason.isNotNull())
        .drop("config_source")
    )


def wants_page(mode: Column, feed_body: Column) -> Column:
    return (mode == "article_always") | (
        (mode == "article") & (F.length(feed_body) < SHORT_FEED_CHARS)
    )


def with_bodies(listed: DataFrame, pages: DataFrame) -> DataFrame:
    """The page's text where it is wanted, long enough, and longer than the feed's own.

    ``pages`` holds (url, page_text). A page that could not be read has no row, and its article
    keeps the feed body.
    """
    asked = wants_page(F.col("body_extraction"), F.col("body"))
    texts = first_by(pages, ["url"], [F.length("page_text").desc(), F.col("page_text")])
    wanting = listed.withColumn("page_asked", asked).withColumn("page_url", F.when(asked, F.col("url")))
    # Entries that want no page have no key and go round the join.
    found = left_join_present(wanting, texts.withColumnRenamed("url", "page_url"), "page_url").drop("page_url")
    better = (
        F.col("page_asked")
        & (F.length("page_text") >= MIN_ARTICLE_CHARS)
        & (F.length("page_text") > F.length("body"))
    )
    return found.withColumn("page_used", F.coalesce(better, F.lit(False))).withColumn(
        "body", F.when(F.col("page_used"), F.col("page_text")).otherwise(F.col("body"))
    ).drop("page_text")


def marked_duplicates(listed: DataFrame) -> DataFrame:
    """An address counts once per cycle: in the first configured source, at its best rank.

    The first place per address is a grouped minimum joined back, so an address that most
    sources carry is combined before the shuffle.
    """
    place = F.struct("config_place", "rank")
    first = listed.groupBy("cycle", "url").agg(F.min(place).alias("first_place"))
    return (
        listed.join(first, ["cycle", "url"])
        .withColumn("duplicate", place != F.col("first_place"))
        .drop("first_place")
    )


@dataclass
class Ingested:
    items: DataFrame
    bodies: DataFrame
    failures: DataFrame
    marked: DataFrame

    def counters(self) -> DataFrame:
        """Collected and skipped entries, and what opening pages brought, per cycle."""
        return self.marked.groupBy("cycle").agg(
            F.count_if(~F.col("duplicate")).alias("collected"),
            F.count_if("duplicate").alias("duplicates"),
            F.count_if("page_asked").alias("pages_asked"),
            F.count_if("page_used").alias("pages_used"),
            F.count_if(F.col("page_asked") & ~F.col("page_used")).alias("feed_body_kept"),
        )


def bronze_rows(marked: DataFrame, collected_at: Column) -> tuple[DataFrame, DataFrame]:
    """Observations and body texts of the entries that are no duplicates."""
    kept = marked.filter(~F.col("duplicate")).withColumn("has_body", F.col("body") != "")
    hashed = F.when(F.col("has_body"), identity.body_hash(F.col("body"))).otherwise(F.lit(""))
    rows = kept.withColumn("body_hash", hashed).withColumn("collected_at", collected_at)
    items = rows.select(
        identity.record_id(F.col("source_id"), F.col("url"), F.col("cycle")).alias("record_id"),
        "source_id",
        "axis",
        "rank",
        "view_count",
        "title",
        F.col("url").alias("source_url"),
        "body_hash",
        F.col("has_body").alias("body_available"),
        "collected_at",
        F.col("cycle").alias("collection_cycle"),
    )
    return items, body_rows(
        rows.filter("has_body").select("body_hash", F.col("body").alias("raw_text"),
                                       "collected_at", "cycle")
    )


def body_rows(texts: DataFrame) -> DataFrame:
    """One row per text, at its first sighting."""
    first = F.min(F.struct("collected_at", "cycle"))
    return texts.groupBy("body_hash").agg(
        F.any_value("raw_text").alias("raw_text"), first.alias("first")
    ).select(
        "body_hash",
        "raw_text",
        F.col("first.collected_at").alias("first_seen_at"),
        F.col("first.cycle").alias("first_seen_cycle"),
    )


def ingested(
    configs: DataFrame,
    attempts: DataFrame,
    pages: DataFrame,
    collected_at: Column,
    retries: int = DEFAULT_RETRIES,
) -> Ingested:
    """The whole way from landing table to Bronze rows."""
    # Written, so that Spark knows how small it is: else payloads are shuffled by source to meet their settings, and
    # each source is parsed in one task.
    configs = staged(configs, "configs")
    answered, unreached = acquired(attempts, retries)
    told = answered.join(configs.select("source_id", "format"), "source_id")
    parsed = _feed_entries(told.filter("format = 'rss'")).unionByName(_search_entries(told.filter("format = 'worldbank-json'")))
    path = scratch_path(spark := told.sparkSession, "marked-entries")
    malformed = scratch_path(spark, "malformed")
    with scratch_scope(spark):
        # Parsed once: the choice of first places reads these rows twice, the outputs read the marked ones.
        listed, bad = _apart(staged(ranked(parsed, configs), "ranked-entries"))
        bad = staged(bad, "malformed", malformed)
        marked = staged(marked_duplicates(with_bodies(listed, pages)), "marked-entries", path)
    items, bodies = bronze_rows(marked, collected_at)
    return Ingested(items, bodies, unreached.unionByName(bad), marked)
