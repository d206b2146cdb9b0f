"""Registered queries over the collection and labelling jobs.

The landing table is derived from ``documents``: each document becomes one fetched payload of
its source in a cycle of its own, and each line of its text one entry of that payload, as RSS,
Atom or a search reply. What the jobs read back out of the payloads must equal what went in.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.functions import replies, subjects
from pressgauge.functions import vocabulary as V
from pressgauge.plans import ingestion, labelling
from pressgauge.schemas import PARTITION
from pressgauge.session import scratch_path, staged
from pressgauge.sources import feeds, pages
from pressgauge.sources.lake import Lake
from pressgauge.workload import tables
from pressgauge.workload.oracle import sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None, **extra: str):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = sql(oracle, extra)
        return fn

    return register


# -- landing table ----------------------------------------------------------------------------

_CYCLE = (
    "date_format(timestamp_seconds(1704067200 + (doc_id div 20) * 3600), \"yyyy-MM-dd'T'HH:00\")"
)


def _escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _address(line: Column) -> Column:
    return F.concat(F.lit("https://news.example/"), F.md5(line))


def _title(line: Column) -> Column:
    return F.substring(line, 1, 30)


def _lines() -> Column:
    clean = F.transform(F.split("text", "\n"), subjects.collapse_ends)
    return F.filter(clean, lambda x: x != "")


def _tag(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """One payload per document, the format by document number; one in fifty is cut short."""
    rss = F.concat(
        F.lit('<?xml version="1.0"?><rss xmlns:c="http://content.example/"><channel>'),
        F.array_join(
            F.transform(
                "lines",
                lambda x: _tag(
                    "item",
                    F.concat(
                        _tag("title", _escaped(_title(x))),
                        _tag("link", _address(x)),
                        _tag("c:encoded", _escaped(x)),
                        _tag("description", F.lit("short")),
                        _tag("views", F.length(x).cast("string")),
                    ),
                ),
            ),
            "",
        ),
        F.lit("</channel></rss>"),
    )
    atom = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'),
        F.array_join(
            F.transform(
                "lines",
                lambda x: _tag(
                    "entry",
                    F.concat(
                        _tag("title", _escaped(_title(x))),
                        F.lit('<link rel="self" href="https://other.example/"/><link href="'),
                        _address(x),
                        F.lit('"/>'),
                        _tag("summary", _escaped(x)),
                    ),
                ),
            ),
            "",
        ),
        F.lit("</feed>"),
    )
    def wrapped(value: Column) -> Column:
        return F.named_struct(F.lit("cdata!"), value)

    reply = F.to_json(
        F.struct(
            F.map_from_entries(
                F.transform(
                    "lines",
                    lambda x, i: F.struct(
                        F.format_string("d%06d", i),
                        F.struct(
                            _address(x).alias("url"),
                            wrapped(_title(x)).alias("title"),
                            wrapped(x).alias("content"),
                        ),
                    ),
                )
            ).alias("documents")
        )
    )
    whole = F.when(F.col("doc_id") % 3 == 0, rss).when(F.col("doc_id") % 3 == 1, atom).otherwise(reply)
    cut = F.col("doc_id") % 50 == 7
    return (
        tables.table(spark, sf, "documents")
        .withColumn("lines", _lines())
        .select(
            "doc_id",
            F.when(F.col("doc_id") % 3 == 2, F.concat("source", F.lit("-search"))).otherwise(F.col("source")).alias("source_id"),
            F.expr(_CYCLE).alias("cycle"),
            F.when(cut, F.substr(whole, F.lit(1), F.length(whole) - 9))
            .otherwise(whole)
            .alias("payload"),
        )
    )


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """The landing table as the jobs find it: written, in many files."""
    return staged(_fetched(spark, sf).repartition("source_id", "cycle"), "landing")


def _fetched(spark: SparkSession, sf: str) -> DataFrame:
    """Fetch attempts: a quarter of the payloads came on the second try, one in 25 never."""
    never = F.col("doc_id") % 25 == 3
    late = F.col("doc_id") % 4 == 1
    tries = F.when(never, F.array(F.lit(1), F.lit(2), F.lit(3))).when(
        late, F.array(F.lit(1), F.lit(2))
    ).otherwise(F.array(F.lit(1)))
    good = ~never & (~late | (F.col("attempt") == 2))
    return payloads(spark, sf).select("*", F.explode(tries).alias("attempt")).select(
        "doc_id",
        "source_id",
        "cycle",
        "attempt",
        F.when(good, F.col("payload")).alias("payload"),
        F.when(~good, F.concat(F.lit("timeout "), F.col("attempt"))).alias("error"),
    )


def configs(spark: SparkSession, sf: str) -> DataFrame:
    """Two configured sources per document source: its feed and its search."""
    number = F.substring("source", 4, 9).cast("int")
    docs = tables.table(spark, sf, "documents")
    named = docs.select("source", (F.col("doc_id") % 3 == 2).alias("search")).distinct()
    modes = F.array(*[F.lit(m) for m in feeds.BODY_MODES])
    axes = F.array(*[F.lit(a) for a in V.AXES])
    return named.select(
        (number * 2 + F.col("search").cast("int")).alias("place"),
        F.when(F.col("search"), F.concat("source", F.lit("-search"))).otherwise(F.col("source")).alias("source_id"),
        F.element_at(axes, number % 3 + 1).alias("axis"),
        F.concat(F.lit("https://feeds.example/"), "source").alias("feed_url"),
        (number % 5 + 2).alias("limit"),
        F.element_at(modes, number % 3 + 1).alias("body_extraction"),
        F.when(F.col("search"), "worldbank-json").otherwise("rss").alias("format"),
    )


def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Page texts of every second address, three times as long as the line."""
    lines = tables.table(spark, sf, "documents").select(F.explode(_lines()).alias("line")).distinct()
    return lines.filter(F.ascii(F.md5("line")) % 2 == 0).select(
        _address(F.col("line")).alias("url"), F.repeat("line", F.lit(3)).alias("page_text")
    )


_DOCS = {
    "cut_lines": "SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, "
    "unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents",
    "entries": "SELECT doc_id, source || CASE doc_id % 3 WHEN 2 THEN '-search' ELSE '' END AS source_id, strftime(make_timestamp((1704067200 + "
    "(doc_id // 20) * 3600) * 1000000), '%Y-%m-%dT%H:00') AS cycle, "
    "row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS place, trim(line) AS line "
    "FROM cut_lines WHERE trim(line) <> ''",
    "articles": "SELECT doc_id, source_id, cycle, place, trim(substr(line, 1, 30)) AS title, "
    "'https://news.example/' || md5(line) AS url, line AS body, CASE doc_id % 3 WHEN 0 "
    "THEN length(line) ELSE 0 END AS view_count FROM entries "
    "WHERE doc_id % 50 <> 7 AND doc_id % 25 <> 3",
    "conf": "SELECT DISTINCT source || CASE doc_id % 3 WHEN 2 THEN '-search' ELSE '' END AS source_id, "
    "CAST(substr(source, 4) AS INTEGER) AS base, base * 2 + CASE doc_id % 3 WHEN 2 THEN 1 ELSE 0 END AS num, "
    "base % 5 + 2 AS lim, ['KR', 'US', 'GLOBAL'][base % 3 + 1] AS axis, "
    "['feed', 'article', 'article_always'][base % 3 + 1] AS mode FROM documents",
    "leaders": "SELECT a.*, c.axis, c.num, c.mode, row_number() OVER (PARTITION BY source_id, "
    "cycle ORDER BY view_count DESC, place) AS rank FROM articles a JOIN conf c USING (source_id) "
    "QUALIFY rank <= c.lim",
    "fulltexts": "SELECT DISTINCT 'https://news.example/' || md5(line) AS url, repeat(line, 3) "
    "AS page_text FROM entries WHERE ascii(md5(line)) % 2 = 0",
    "asked": "SELECT l.*, (mode = 'article_always' OR (mode = 'article' AND length(body) < 300)) "
    "AS page_asked, page_text FROM leaders l LEFT JOIN fulltexts USING (url)",
    "bodied": "SELECT * EXCLUDE (body, page_text), CASE WHEN page_used THEN page_text ELSE body "
    "END AS body FROM (SELECT *, coalesce(page_asked AND length(page_text) >= 200 "
    "AND length(page_text) > length(body), false) AS page_used FROM asked)",
    "deduped": "SELECT *, row_number() OVER (PARTITION BY cycle, url ORDER BY num, rank) > 1 "
    "AS duplicate FROM bodied",
    "items": "SELECT substr(sha1(source_id || '|' || url || '|' || cycle), 1, 12) AS record_id, "
    "source_id, axis, rank, view_count, title, url AS source_url, sha256(body) AS body_hash, "
    "true AS body_available, '2024-02-01T00:00:00+00:00' AS collected_at, "
    "cycle AS collection_cycle, body FROM deduped WHERE NOT duplicate",
}
_COLLECTED = "2024-02-01T00:00:00+00:00"


def _answered(spark: SparkSession, sf: str, fmt: str) -> DataFrame:
    answered, _ = feeds.acquired(attempts(spark, sf))
    return answered.join(configs(spark, sf).filter(F.col("format") == fmt).select("source_id"), "source_id")


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked entries with their bodies, before duplicates go."""
    return feeds.ingested(configs(spark, sf), attempts(spark, sf), page_texts(spark, sf), F.lit(_COLLECTED)).marked


def _collected(spark: SparkSession, sf: str) -> tuple[Lake, dict[str, DataFrame]]:
    """A lake after the collection job over the landing table, and what the job says of it."""
    lake = Lake(spark, scratch_path(spark, "lake"))
    return lake, ingestion.collect(lake, configs(spark, sf), attempts(spark, sf), page_texts(spark, sf), _COLLECTED)


_SOURCE = "source || CASE doc_id % 3 WHEN 2 THEN '-search' ELSE '' END AS source_id"


@query(
    "s7_acquired_payloads",
    f"SELECT {_SOURCE}, strftime(make_timestamp((1704067200 + (doc_id // 20) * 3600) * "
    "1000000), '%Y-%m-%dT%H:00') AS cycle FROM documents WHERE doc_id % 25 <> 3",
)
def acquired(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.acquired(attempts(spark, sf))[0].select("source_id", "cycle")


@query(
    "s7_failed_sources",
    f"SELECT {_SOURCE}, strftime(make_timestamp((1704067200 + (doc_id // 20) * 3600) * "
    "1000000), '%Y-%m-%dT%H:00') AS cycle, 'failed after retries: timeout 3' AS reason "
    "FROM documents WHERE doc_id % 25 = 3",
)
def failed_sources(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.acquired(attempts(spark, sf))[1]


_ARTICLE = "source_id, cycle, place, title, url, body, view_count"


@query(
    "s8_x19_feed_articles",
    f"SELECT {_ARTICLE} FROM articles WHERE doc_id % 3 <> 2",
    **_DOCS,
)
def feed_articles(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.parse_feeds(_answered(spark, sf, "rss"))[0]


@query(
    "s9_search_articles",
    f"SELECT {_ARTICLE} FROM articles WHERE doc_id % 3 = 2",
    **_DOCS,
)
def search_articles(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.parse_search_replies(_answered(spark, sf, "worldbank-json"))[0]


@query(
    "s8_s9_malformed_payloads",
    f"SELECT {_SOURCE}, strftime(make_timestamp((1704067200 + (doc_id // 20) * 3600) * "
    "1000000), '%Y-%m-%dT%H:00') AS cycle, CASE doc_id % 3 WHEN 2 THEN "
    "'malformed worldbank-json response' ELSE 'malformed feed' END AS reason "
    "FROM documents WHERE doc_id % 50 = 7 AND doc_id % 25 <> 3",
)
def malformed(spark: SparkSession, sf: str) -> DataFrame:
    return _collected(spark, sf)[1]["failures"].where("reason LIKE 'malformed%'")


@query(
    "s10_feed_config",
    "SELECT CAST(row_number() OVER (ORDER BY num) - 1 AS INTEGER) AS place, source_id, axis, lim AS limit, "
    "mode AS body_extraction, CASE num % 2 WHEN 1 THEN 'worldbank-json' ELSE 'rss' END AS format FROM conf",
    **_DOCS,
)
def feed_config(spark: SparkSession, sf: str) -> DataFrame:
    """The configuration as a file of one JSON array, written and read again."""
    listed = configs(spark, sf)
    text = listed.agg(F.to_json(F.sort_array(F.collect_list(
        F.struct(F.col("place").alias("n"), *(c for c in listed.columns if c != "place"))
    ))).alias("value"))
    path = scratch_path(spark, "feeds")
    text.write.text(path)
    return feeds.feed_configs(spark, path).select(
        F.col("place").cast("int").alias("place"), "source_id", "axis", "limit",
        "body_extraction", "format",
    )


@query(
    "w10_l1_ranked_entries",
    "SELECT source_id, cycle, url, place, rank FROM leaders",
    **_DOCS,
)
def ranked_entries(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).select("source_id", "cycle", "url", "place", "rank")


@query(
    "s13_w11_bodies_and_duplicates",
    "SELECT source_id, cycle, url, rank, page_asked, page_used, body, duplicate FROM deduped",
    **_DOCS,
)
def bodies_and_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).select(
        "source_id", "cycle", "url", "rank", "page_asked", "page_used", "body", "duplicate"
    )


@query(
    "a28_intake_counters",
    "SELECT cycle, count(*) FILTER (NOT duplicate) AS collected, count(*) FILTER (duplicate) AS "
    "duplicates, count(*) FILTER (page_asked) AS pages_asked, count(*) FILTER (page_used) AS "
    "pages_used, count(*) FILTER (page_asked AND NOT page_used) AS feed_body_kept "
    "FROM deduped GROUP BY cycle",
    **_DOCS,
)
def intake_counters(spark: SparkSession, sf: str) -> DataFrame:
    return _collected(spark, sf)[1]["counters"]


@query("b1_bronze_items", "SELECT * EXCLUDE (body) FROM items", **_DOCS)
def bronze_items(spark: SparkSession, sf: str) -> DataFrame:
    return _collected(spark, sf)[0].read_cycles("bronze", "news_item").drop(*PARTITION)


@query(
    "b1_w12_bronze_bodies",
    "SELECT body_hash, any_value(body) AS raw_text, min(collected_at) AS first_seen_at, "
    "min(collection_cycle) AS first_seen_cycle FROM items GROUP BY body_hash",
    **_DOCS,
)
def bronze_bodies(spark: SparkSession, sf: str) -> DataFrame:
    lake, _ = _collected(spark, sf)
    return lake.read_objects("bronze", "news_body", "body_hash").drop("body_hash_prefix")


_PLAIN = "CASE WHEN doc_id % 3 = 0 THEN '경제' || chr(10) || regexp_replace(text, '[^\x00-\x7F]', '?', 'g') ELSE text END"


@query(
    "s11_s12_built_pages",
    # The text of each line, blanks squeezed; every third page is CP949 and begins with a Korean line.
    f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split({_PLAIN}, chr(10)), "
    r"lambda x: trim(regexp_replace(x, '[ \t\r\f\v]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS page_text "
    "FROM documents",
)
def built_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as web pages: teasers and menus around them, every second text split over two blocks,
    declared UTF-8, undeclared UTF-8 and undeclared CP949."""
    narrow = F.regexp_replace("text", r"[^\x00-\x7F]", "?")
    text = F.when(F.col("doc_id") % 3 == 0, narrow).otherwise(F.col("text"))
    docs = tables.table(spark, sf, "documents").select("doc_id", text.alias("text"))
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = docs.withColumn("lines", F.split(safe, "\n"))
    paragraphs = lambda part: F.array_join(F.transform(part, lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    half = F.when(F.col("doc_id") % 2 == 0, F.size("lines")).otherwise((F.size("lines") + 1) / 2).cast("int")
    first, rest = paragraphs(F.slice("lines", F.lit(1), half)), paragraphs(F.slice("lines", half + 1, F.size("lines")))
    head = F.when(F.col("doc_id") % 3 == 1, '<html><head><meta charset="utf-8"></head><body>').otherwise("<html><body>")
    top = F.concat(head, F.lit('<nav><a href="/">menu</a> home</nav><div class="text body"><a href="/1">a teaser</a></div><main>'
                               '<div class="text  body">'))
    foot = F.lit('</div></main><aside>more</aside><script>var x = "</p>";</script></body></html>')
    korean = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("3C703EB0E6C1A63C2F703E"))).otherwise(F.unhex(F.lit("")))
    raw = F.concat(F.encode(top, "utf-8"), korean, F.encode(F.concat(first, F.lit('</div><div class="text body">'), rest, foot), "utf-8"))
    named = lines.select(F.col("doc_id").cast("string").alias("url"), raw.alias("payload"))
    return pages.page_texts(named).select(F.col("url").cast("bigint").alias("doc_id"), "page_text")


@query("s11_s12_x24_article_text")
def article_text(spark: SparkSession, sf: str) -> DataFrame:
    raw = tables.table(spark, sf, "pages").select("url", F.col("html").alias("payload"))
    return pages.page_texts(raw)


# -- keyword labels and subject names ---------------------------------------------------------

_STARTS = ("Samsung", "FED", "환율", "코스피", "nvidia", "S&P 500", "AI 반도체 CAPEX", "none")
_TONES = ("positive", "mixed", "excited", "negative", "neutral")


def _listed(words: tuple[str, ...], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (place % len(words) + 1).cast("int"))


def titled_documents(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents as observations with marks for the keyword rules, and their body table."""
    title = F.concat(_listed(_STARTS, F.col("doc_id")), F.lit(" - "), F.substring("text", 1, 40))
    body = F.concat(
        "text", F.lit(" tone="), _listed(_TONES, F.col("doc_id")), F.lit(" 대상국=KR, US,, "),
        "lang", F.lit(". end"),
    )
    rows = tables.table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("record_id"),
        F.concat(F.lit("https://docs.example/"), F.col("doc_id").cast("string")).alias(
            "source_url"
        ),
        title.alias("title"),
        body.alias("raw_text"),
        F.sha2(body, 256).alias("body_hash"),
        (F.col("doc_id") % 9 != 4).alias("body_available"),
        F.lit("2024-01-01T00:00:00+00:00").alias("collected_at"),
    )
    texts = rows.select("body_hash", "raw_text", F.col("collected_at").alias("first_seen_at"))
    return rows.drop("raw_text"), texts


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_TITLE_CASE = "CASE " + " ".join(
    f"WHEN contains(lower(title), '{needle}') THEN '{name}'"
    for needle, name in (*V.TITLE_ALIASES, *((s.lower(), s) for s in V.SUBJECTS))
) + " END"
_KEYWORD = {
    "titled": "SELECT doc_id, 'd' || doc_id AS record_id, "
    f"{_sql_list(_STARTS)}[doc_id % {len(_STARTS)} + 1] || ' - ' || substr(text, 1, 40) AS title, "
    f"{_sql_list(_TONES)}[doc_id % {len(_TONES)} + 1] AS tone, lang, text, "
    "doc_id % 9 <> 4 AS body_available FROM documents",
    "toned": "SELECT *, CASE WHEN body_available AND tone <> 'excited' THEN tone END AS sentiment "
    "FROM titled",
}


@query(
    "x18_keyword_labels",
    f"SELECT record_id, coalesce({_TITLE_CASE}, '') AS narrative_subjects, sentiment, "
    "CASE WHEN body_available THEN 'KR,US,' || lang ELSE '' END AS target_countries, "
    "CASE WHEN sentiment IS NULL THEN 'unanalyzed' WHEN sentiment = 'mixed' THEN 'low_confidence' "
    "ELSE 'analyzed' END AS analysis_status, CASE WHEN sentiment IS NULL THEN 0.0::DOUBLE "
    "WHEN sentiment = 'mixed' THEN 0.55::DOUBLE ELSE 0.92::DOUBLE END AS confidence, "
    "'keyword_analyzer' AS no_call_reason FROM toned",
    **_KEYWORD,
)
def keyword_labels(spark: SparkSession, sf: str) -> DataFrame:
    items, texts = titled_documents(spark, sf)
    return labelling.keyword_labels(items, texts).select(
        "record_id",
        F.concat_ws(",", "narrative_subjects").alias("narrative_subjects"),
        "sentiment",
        F.concat_ws(",", "target_countries").alias("target_countries"),
        "analysis_status",
        "confidence",
        "no_call_reason",
    )


_SPELLED = [(name, own) for own, names in V.SPELLINGS.items() for name in names]
_FORMS = tuple(name for name, _ in _SPELLED) + ("미지의 주제",)
_NAMES = tuple(own for _, own in _SPELLED) + ("미지의 주제",)


@query(
    "x10_j14_canonical_subjects",
    f"SELECT doc_id, {_sql_list(_NAMES)}[doc_id % {len(_NAMES)} + 1] AS subject FROM documents",
)
def canonical_subjects(spark: SparkSession, sf: str) -> DataFrame:
    """Every surface form in four spellings: as listed, upper case, spread out, with a gloss."""
    form = _listed(_FORMS, F.col("doc_id"))
    spelled = (
        F.when(F.col("doc_id") % 4 == 0, form)
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("  "), form, F.lit(" ")))
        .when(F.col("doc_id") % 4 == 2, F.replace(form, F.lit(" "), F.lit("   ")))
        .otherwise(F.concat(form, F.lit(" (ABC-1)")))
    )
    return tables.table(spark, sf, "documents").select(
        "doc_id", subjects.canonical_subject(spelled).alias("subject")
    )


@query(
    "x11_canonical_categories",
    f"SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN '기타' ELSE "
    f"{_sql_list(V.CATEGORIES)}[doc_id % 25 + 1] || CASE WHEN doc_id % 25 = (doc_id + 8) % 25 "
    f"THEN '' ELSE ',' || {_sql_list(V.CATEGORIES)}[(doc_id + 8) % 25 + 1] END END AS categories "
    "FROM documents",
)
def canonical_categories(spark: SparkSession, sf: str) -> DataFrame:
    one, two = (_listed(V.CATEGORIES, F.col("doc_id") + n) for n in (0, 8))
    spaced = F.concat(F.lit(" "), F.replace(one, F.lit("·"), F.lit(" · ")))
    names = (
        F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("array<string>"))
        .when(F.col("doc_id") % 7 == 1, F.array(F.lit("not listed")))
        .otherwise(F.array(F.lit("unknown"), spaced, one, two, two, F.lit("물가")))
    )
    kept = subjects.canonical_categories(names)
    return tables.table(spark, sf, "documents").select(
        "doc_id", F.when(kept.isNotNull(), F.array_join(kept, ",")).alias("categories")
    )


# -- model replies ----------------------------------------------------------------------------

_REPLY_KIND = "(conv_id * 3 + turn) % 8"


@query(
    "x12_x15_reply_judgement",
    "SELECT conv_id, turn, kind NOT IN (5, 6) AS usable, "
    "CASE WHEN kind IN (4, 5, 6) THEN NULL ELSE ['positive', 'neutral', 'negative', 'mixed']"
    "[conv_id % 4 + 1] END AS sentiment, "
    "CASE WHEN kind IN (4, 5, 6) THEN NULL WHEN kind = 3 THEN 1.0::DOUBLE WHEN kind = 2 THEN "
    "0.0::DOUBLE ELSE (conv_id % 11)::DOUBLE / 10.0::DOUBLE END AS confidence, "
    "CASE WHEN kind IN (5, 6) THEN NULL WHEN kind = 4 THEN 'unanalyzed' WHEN kind = 3 THEN "
    "'analyzed' WHEN kind = 2 THEN 'low_confidence' WHEN conv_id % 11 >= 6 THEN 'analyzed' "
    "ELSE 'low_confidence' END AS status, "
    "CASE WHEN kind IN (5, 6) THEN NULL WHEN kind = 4 THEN '' ELSE role || ',국제통화기금' END "
    "AS subjects FROM replied",
    replied=f"SELECT *, {_REPLY_KIND} AS kind FROM conversations",
)
def reply_judgement(spark: SparkSession, sf: str) -> DataFrame:
    """Replies wrapped in prose: plain, odd confidences, declined, no JSON, no valid tone.

    The whole turn text travels inside each reply, quotes, braces and line breaks included.
    """
    kind = F.expr(_REPLY_KIND)
    tone = _listed(V.SENTIMENTS, F.col("conv_id"))
    number = (F.col("conv_id") % 11) / 10.0
    fields = F.to_json(
        F.struct(
            F.array(F.lit("KR")).alias("target_countries"),
            F.array(F.col("role"), F.lit(" IMF "), F.lit("국제통화기금 (IMF)"), F.lit(" ")).alias(
                "narrative_subjects"
            ),
            F.when(kind == 6, F.lit("glad")).otherwise(tone).alias("sentiment"),
            F.col("text").alias("sentiment_rationale"),
            (kind != 4).alias("analyzable"),
        )
    )
    confidence = (
        F.when(kind == 3, F.lit("7"))
        .when(kind == 2, F.lit('"high"'))
        .otherwise(number.cast("string"))
    )
    text = F.when(kind == 5, F.lit("no object here")).otherwise(
        F.concat(
            F.lit("Here it is:\n```json\n"),
            F.substr(fields, F.lit(1), F.length(fields) - 1),
            F.lit(', "confidence": '),
            confidence,
            F.lit("}\n```"),
        )
    )
    parsed = F.col("parsed")
    judged = replies.judgement(parsed)
    usable = F.coalesce(replies.is_usable(parsed), F.lit(False))
    rows = tables.table(spark, sf, "conversations").select(
        "conv_id", "turn", text.alias("reply"), kind.alias("kind")
    ).withColumn("parsed", replies.reply_object(F.col("reply")))
    return rows.select("conv_id", "turn", "kind", usable.alias("usable"), judged.alias("j")).select(
        "conv_id",
        "turn",
        "usable",
        F.when(F.col("usable"), F.col("j.sentiment")).alias("sentiment"),
        F.when(F.col("usable") & (F.col("kind") != 4), F.col("j.confidence")).alias("confidence"),
        F.when(F.col("usable"), F.col("j.analysis_status")).alias("status"),
        F.when(F.col("usable"), F.array_join("j.narrative_subjects", ",")).alias("subjects"),
    )


def canned_completer(_system: str, user: str) -> str:
    """A stand-in model whose answer is a function of the prompt's length."""
    n = len(user)
    if n % 11 == 0:
        raise RuntimeError("busy")
    if n % 13 == 0:
        return "I cannot say"
    return json.dumps(
        {
            "target_countries": ["KR"],
            "narrative_subjects": ["the Fed", f"s{n % 5}"],
            "subject_categories": ["물가"] if n % 2 else None,
            "sentiment": V.SENTIMENTS[n % 4],
            "analyzable": n % 7 != 0,
            "confidence": (n % 10) / 10,
        }
    )


def prompted_documents(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = tables.table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.format_string("%012d", "doc_id")).alias("record_id"),
        F.lit("").alias("source_url"),
        F.col("lang").alias("title"),
        F.col("text").alias("raw_text"),
        F.sha2("text", 256).alias("body_hash"),
        (F.col("doc_id") % 10 != 9).alias("body_available"),
        F.lit("2024-01-01T00:00:00+00:00").alias("collected_at"),
    )
    texts = rows.select("body_hash", "raw_text", F.col("collected_at").alias("first_seen_at"))
    return rows.drop("raw_text"), texts


def _labelled(spark: SparkSession, sf: str) -> labelling.Labelled:
    items, texts = prompted_documents(spark, sf)
    cache = spark.createDataFrame(
        [], "cache_key string, reply string, model string, analyzer_version string, "
        "first_seen_at string, call_id string"
    )
    return labelling.model_labels(
        items, texts, cache, canned_completer, "v9", "run-9", "canned", 0.0,
        "2024-03-01T00:00:00+00:00", "system",
    )


_MODEL = {
    "prompted": "SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS record_id, "
    "'TITLE: ' || lang || chr(10) || chr(10) || 'BODY:' || chr(10) || text AS prompt, "
    "doc_id % 10 <> 9 AND text <> '' AS reaches, length(prompt) AS n FROM documents",
    "ordered": "SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY record_id) AS turn_no, "
    "CASE WHEN n % 11 = 0 THEN 'call_failed' WHEN n % 13 = 0 THEN 'parse_failed' "
    "WHEN turn_no > 1 THEN 'reused' ELSE 'parsed' END AS outcome FROM prompted WHERE reaches",
}


@query(
    "f2_f3_model_analyses",
    "SELECT record_id, CASE WHEN outcome IN ('parsed', 'reused') AND n % 7 <> 0 THEN "
    "['positive', 'neutral', 'negative', 'mixed'][n % 4 + 1] END AS sentiment, "
    "CASE WHEN outcome IN ('parsed', 'reused') AND n % 7 <> 0 THEN CASE WHEN n % 10 >= 6 THEN "
    "'analyzed' ELSE 'low_confidence' END ELSE 'unanalyzed' END AS analysis_status, "
    "CASE WHEN outcome IN ('parsed', 'reused') AND n % 7 <> 0 THEN '연준,s' || n % 5 ELSE '' END "
    "AS subjects, CASE WHEN outcome IN ('parsed', 'reused') AND n % 7 <> 0 AND n % 2 = 1 "
    "THEN '물가' END AS categories, CAST(NULL AS VARCHAR) AS no_call_reason FROM ordered "
    "UNION ALL SELECT record_id, NULL, 'unanalyzed', '', NULL, 'body_unavailable' FROM prompted "
    "WHERE NOT reaches",
    **_MODEL,
)
def model_analyses(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf).analyses.select(
        "record_id",
        "sentiment",
        "analysis_status",
        F.array_join("narrative_subjects", ",").alias("subjects"),
        F.array_join("subject_categories", ",").alias("categories"),
        "no_call_reason",
    )


@query(
    "f3_j18_t9_model_calls",
    "SELECT record_id, outcome AS call_outcome, sha256('system' || chr(0) || prompt) AS "
    "prompt_sha256, CASE WHEN turn_no = 1 THEN 1 ELSE 0 END AS call_attempt_count, "
    "outcome = 'reused' AS names_origin FROM ordered",
    **_MODEL,
)
def model_calls(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf).calls.select(
        "record_id",
        "call_outcome",
        "prompt_sha256",
        "call_attempt_count",
        F.col("reused_from_call_id").isNotNull().alias("names_origin"),
    )


@query(
    "f3_t8_model_counts",
    "SELECT count(*) FILTER (turn_no = 1) AS attempted, count(*) FILTER (turn_no = 1 AND "
    "outcome LIKE '%failed') AS failed, count(*) FILTER (outcome = 'reused') AS reused "
    "FROM ordered",
    **_MODEL,
)
def model_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf).counts().drop("last_error")


@query(
    "x16_reply_cache",
    "SELECT 'canned' AS model, 'v9' AS analyzer_version, count(*) AS replies, "
    "count(DISTINCT prompt) AS keys FROM ordered WHERE outcome = 'parsed'",
    **_MODEL,
)
def reply_cache(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _labelled(spark, sf)
        .new_replies.groupBy("model", "analyzer_version")
        .agg(F.count("*").alias("replies"), F.count_distinct("cache_key").alias("keys"))
    )


@query(
    "j18_stored_replies_replayed",
    "SELECT record_id, CASE WHEN outcome IN ('parsed', 'reused') THEN 'reused' ELSE outcome END "
    "AS call_outcome, outcome IN ('parsed', 'reused') AS names_origin FROM ordered",
    **_MODEL,
)
def stored_replies(spark: SparkSession, sf: str) -> DataFrame:
    """A second run over the same documents: what the first stored is replayed, not asked."""
    items, texts = prompted_documents(spark, sf)
    done = labelling.model_labels(
        items, texts, _labelled(spark, sf).new_replies, canned_completer, "v9", "run-10",
        "canned", 0.0, "2024-03-02T00:00:00+00:00", "system",
    )
    return done.calls.select(
        "record_id", "call_outcome", F.col("reused_from_call_id").isNotNull().alias("names_origin")
    )
