"""Queries on what Spark derives from the tables: evidence, fragments, headings, columns, page claims and running jobs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import grounding as G
from marginalia.operators import pages as P
from marginalia.plans.catalogue import NORM_SQL, PAGE_SQL, query
from marginalia.sources.tables import kept, pages, table
from marginalia.streaming import jobs as J
from marginalia.streaming import stateful as ST

#: Quotes of every page: 80 characters of it, said to be on the page before, with the page two before and its own as the section's; and 40 of it turned round, which no page should hold.
EVIDENCE_SQL = f"""WITH {PAGE_SQL}, n AS (SELECT doc, page_no, {NORM_SQL.format('text')} AS norm FROM p),
q AS (SELECT doc, page_no AS k, substring(text, 31, 80) AS quote FROM p UNION ALL SELECT doc, -page_no, reverse(substring(text, 31, 40)) FROM p),
e AS (SELECT doc, k, abs(k) - 1 AS declared, abs(k) - 2 AS near, {NORM_SQL.format('quote')} AS needle FROM q),
h AS (SELECT e.doc, k, arg_min(page_no, CASE WHEN page_no = declared THEN 0 WHEN page_no = near THEN 1 WHEN page_no = abs(k) THEN 2 ELSE 10 + page_no END) AS page FROM e JOIN n ON n.doc = e.doc AND contains(norm, needle) WHERE length(needle) >= 15 GROUP BY e.doc, k)
SELECT e.doc, e.k AS quote_id, h.page, CASE WHEN h.page IS NULL THEN 'removed' WHEN h.page = e.declared THEN 'kept' ELSE 'corrected page' END AS action FROM e LEFT JOIN h ON h.doc = e.doc AND h.k = e.k"""


@query(EVIDENCE_SQL)
def evidence_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = kept(pages(spark, sf_dir), "pages")
    own = every.select("doc", F.col("page_no").alias("quote_id"), F.substring("text", 31, 80).alias("quote"))
    turned = every.select("doc", (-F.col("page_no")).alias("quote_id"), F.reverse(F.substring("text", 31, 40)).alias("quote"))
    page = F.abs("quote_id")
    quotes = own.unionByName(turned).select("doc", "quote_id", "quote", (page - 1).alias("declared"), F.array(page - 2, page).alias("section_pages"))
    return G.verify_evidence(G.page_index(every), quotes).select("doc", "quote_id", "page", "action")


@query(f"""WITH {PAGE_SQL}, q AS (SELECT doc, page_no, 0 AS ord, substring(text, 1, 60) AS quote FROM p UNION ALL SELECT doc, page_no, 1, substring(text, 9, 30) FROM p UNION ALL SELECT doc, page_no, 2, lower(substring(text, 1, 60)) FROM p UNION ALL SELECT doc, page_no, 3, substring(text, 61, 40) FROM p),
f AS (SELECT doc, page_no, quote, min(ord) AS ord, {NORM_SQL.format('quote')} AS norm FROM q WHERE quote <> '' GROUP BY doc, page_no, quote)
SELECT doc, page_no, ord, md5(quote) AS quote_md5 FROM f WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.doc = f.doc AND o.page_no = f.page_no AND o.quote <> f.quote AND contains(o.norm, f.norm))""")
def quote_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda n, a, b, how=lambda x: x: F.struct(F.lit(n).alias("ord"), how(F.substring("text", a, b)).alias("quote"))
    quotes = pages(spark, sf_dir).select("doc", "page_no", F.explode(F.array(part(0, 1, 60), part(1, 9, 30), part(2, 1, 60, F.lower), part(3, 61, 40))).alias("x")).select("doc", "page_no", "x.*")
    return G.drop_fragments(quotes.filter("quote != ''")).select("doc", "page_no", "ord", F.md5("quote").alias("quote_md5"))


@query(f"""WITH {PAGE_SQL}, l AS (SELECT doc, page_no, unnest(range(0, len(x))) AS line_no, unnest(x) AS line FROM (SELECT doc, page_no, string_split(substring(text, 1, 400), chr(10)) AS x FROM p)),
s AS (SELECT doc, page_no, line_no, substring(line, 1, 90) AS text, 9 + length(line) % 13 AS size, length(line) % 5 = 0 AS bold FROM l),
b AS (SELECT *, median(size) OVER (PARTITION BY doc) AS body FROM s),
g AS (SELECT *, size >= 1.15 * body AS big FROM b), r AS (SELECT doc, size, dense_rank() OVER (PARTITION BY doc ORDER BY size DESC) AS level FROM (SELECT DISTINCT doc, size FROM g WHERE big)),
c AS (SELECT doc, count(*) AS n FROM r GROUP BY doc),
f AS (SELECT g.*, coalesce(r.level, coalesce(c.n, 0) + 1) AS level FROM g LEFT JOIN r ON big AND r.doc = g.doc AND r.size = g.size LEFT JOIN c ON c.doc = g.doc
 WHERE length(text) BETWEEN 3 AND 120 AND regexp_matches(text, '\\p{{L}}') AND (big OR bold AND g.size >= 0.98 * body AND length(text) <= 70 AND NOT regexp_matches(text, '[.,]$')))
SELECT doc, page_no, line_no, CAST(level AS INTEGER) AS level FROM f QUALIFY row_number() OVER (PARTITION BY doc ORDER BY page_no, line_no) <= 200""")
def line_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of every page's first lines, whose sizes are made up from their lengths."""
    lines = pages(spark, sf_dir).select("doc", "page_no", F.posexplode(F.split(F.substring("text", 1, 400), "\n", -1)).alias("line_no", "line"))
    sized = lines.select("doc", "page_no", "line_no", F.substring("line", 1, 90).alias("text"), (9 + F.length("line") % 13).cast("double").alias("size"), (F.length("line") % 5 == 0).alias("bold"))
    return P.headings(sized.filter(F.col("text").rlike(r"\p{L}") | (F.col("size") > 0))).select("doc", "page_no", "line_no", "level")


#: Every event is a text block of a page of a hundred events, in a column by its id, across the page for one in 17.
BLOCK_SQL = """e AS (SELECT CAST(event_id // 100 AS VARCHAR) AS doc, 1 AS page_no, CAST(event_id % 100 AS INTEGER) AS stream_pos, event_id % 17 = 0 AS wide, event_id % 2 AS side, value AS y0 FROM events),
b AS (SELECT doc, page_no, stream_pos, CASE WHEN wide THEN 2 ELSE side END AS side, CASE WHEN wide OR side = 0 THEN 50.0 ELSE 310.0 END AS x0, y0 FROM e)"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    wide, left = F.col("event_id") % 17 == 0, F.col("event_id") % 2 == 0
    x0, x1 = F.when(wide | left, F.lit(50.0)).otherwise(F.lit(310.0)), F.when(left & ~wide, F.lit(290.0)).otherwise(F.lit(550.0))
    return e.select(F.floor(F.col("event_id") / 100).cast("string").alias("doc"), F.lit(1).alias("page_no"), (F.col("event_id") % 100).cast("int").alias("stream_pos"), x0.alias("x0"), F.col("value").alias("y0"), x1.alias("x1"), (F.col("value") + 10).alias("y1"), F.lit("text").alias("text"), F.lit(600.0).alias("width"), F.lit(100.0).alias("height"))


@query(f"""WITH {BLOCK_SQL}, c AS (SELECT *, sum(CASE WHEN side = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY y0 RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CASE WHEN side = 2 THEN 1 ELSE 0 END AS band,
avg(CASE WHEN side = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc) >= 0.15 AND avg(CASE WHEN side = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc) >= 0.15 AS two FROM b)
SELECT doc, page_no, stream_pos, row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN two THEN band ELSE 0 END, CASE WHEN two THEN side ELSE 0 END, CASE WHEN two THEN y0 ELSE round_even(y0, 0) END, x0, stream_pos) AS place FROM c""")
def block_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.column_order(_blocks(spark, sf_dir))


@query(f"""WITH {BLOCK_SQL}, n AS (SELECT *, lead(side) OVER w AS next_side, lead(y0) OVER w AS next_y0 FROM b WINDOW w AS (PARTITION BY doc ORDER BY stream_pos)),
s AS (SELECT doc, page_no, coalesce(side = next_side AND side < 2, false) AS same, coalesce(next_y0 < y0 - 15.0, false) AS up FROM n)
SELECT doc, page_no, CASE WHEN count(*) FILTER (same) > 0 THEN count(*) FILTER (same AND up) / count(*) FILTER (same) ELSE 0.0 END AS disorder FROM s GROUP BY doc, page_no""")
def block_disorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.stream_disorder(_blocks(spark, sf_dir))


#: Every event claims pages: the number in its props, a span as text, its value, and a truth value. A user's pages are the numbers of the user's events of one kind.
@query("""WITH e AS (SELECT event_id, user_id, event_type, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, value FROM events),
v AS (SELECT DISTINCT user_id, k FROM e WHERE event_type = 'view'),
i AS (SELECT event_id, user_id, k AS page FROM e UNION ALL SELECT event_id, user_id, unnest(range(k, k + 3)) FROM e UNION ALL SELECT event_id, user_id, CAST(value AS INTEGER) FROM e WHERE value = floor(value))
SELECT e.event_id AS claim_id, coalesce(string_agg(DISTINCT v.k::VARCHAR, ',' ORDER BY v.k::VARCHAR), '') AS pages, count(*) FILTER (v.k IS NULL) + 1 + CASE WHEN any_value(e.value) = floor(any_value(e.value)) THEN 0 ELSE 1 END AS dropped
FROM e JOIN i ON i.event_id = e.event_id LEFT JOIN v ON v.user_id = i.user_id AND v.k = i.page GROUP BY e.event_id""")
def event_page_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", k.alias("k"))
    raw = F.parse_json(F.concat(F.lit("["), "k", F.lit(', "pp. '), "k", F.lit("-"), (F.col("k").cast("int") + 2).cast("string"), F.lit('", true, '), F.col("value").cast("string"), F.lit("]")))
    valid = e.filter("event_type = 'view'").select(F.col("user_id").alias("doc"), F.col("k").cast("int").alias("page_no")).distinct()
    found = G.claimed_pages(e.select(F.col("user_id").alias("doc"), F.col("event_id").alias("claim_id"), raw.alias("raw")), valid)
    return found.select("claim_id", F.array_join(F.array_sort(F.transform("pages", lambda p: p.cast("string"))), ",").alias("pages"), "dropped")


#: Every event is a job of its kind that runs for its value in minutes.
@query("""WITH j AS (SELECT event_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value * 60) AS BIGINT) * 1000000 AS e FROM events)
SELECT a.event_type, a.event_id AS job_id, count(*) AS active FROM j a JOIN j b ON b.event_type = a.event_type AND b.s <= a.s AND (b.e > a.s OR b.event_id = a.event_id OR (b.e = b.s AND b.s = a.s)) GROUP BY a.event_type, a.event_id""")
def running_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = F.unix_micros(F.col("ts").cast("timestamp"))
    jobs = table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("job_id"), starts.alias("starts"), (starts + F.floor(F.col("value") * 60).cast("long") * 1_000_000).alias("ends"))
    return J.active_jobs(jobs, "event_type")


#: A user's events are the signs of a job; it is cancelled after a day without one. The last watermark is ten minutes before the newest event.
@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' WHEN 'view' THEN 'reading' ELSE 'analyzing' END AS status, least(1.0, value / 100) AS progress, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY i) > 86400000000 AS late FROM e),
c AS (SELECT user_id, coalesce(min(i) FILTER (status IN ('done', 'error')), 1000000000000) AS final, coalesce(min(i) FILTER (late), 1000000000000) AS gone FROM g GROUP BY user_id),
k AS (SELECT g.*, gone, final FROM g JOIN c USING (user_id) WHERE i < gone AND i <= final),
l AS (SELECT user_id, arg_max(status, i) AS status, max(progress) AS progress, max(t) AS last_seen, any_value(gone) AS gone, any_value(final) AS final FROM k GROUP BY user_id)
SELECT user_id AS job_id, CASE WHEN status IN ('done', 'error') THEN status WHEN gone < 1000000000000 OR last_seen + 86400000000 < (SELECT max(epoch_us(ts)) - 600000000 FROM events) THEN 'cancelled' ELSE status END AS status, progress, last_seen FROM l""")
def job_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "reading").otherwise("analyzing")
    events = stream.select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"), F.least(F.lit(1.0), F.col("value") / 100).alias("progress"))
    return ST.last_jobs(ST.run_once(ST.job_rows(events, 86_400), "jobs"))


#: Every event says its page and a span behind it; a user's pages are the numbers of the user's views.
MENTION_SQL = f"""WITH e AS (SELECT event_id, user_id, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events),
v AS (SELECT user_id, list(DISTINCT CAST(regexp_extract(props, '[0-9]+') AS INTEGER)) AS valid FROM events WHERE event_type = 'view' GROUP BY user_id),
x AS (SELECT event_id, k, coalesce(list_contains(valid, k), false) AS one, coalesce(list_contains(valid, k) AND list_contains(valid, k + 3), false) AS span FROM e LEFT JOIN v USING (user_id))
SELECT event_id, 'See ' || CASE WHEN one THEN 'page ' || k ELSE '{T.UNVERIFIED}' END || ' and ' || CASE WHEN span THEN 'pp. ' || k || '-' || (k + 3) ELSE '{T.UNVERIFIED}' END || '.' AS body, CAST(NOT one AS INTEGER) + CAST(NOT span AS INTEGER) AS removed FROM x"""


@query(MENTION_SQL)
def event_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    valid = e.filter("event_type = 'view'").groupBy("user_id").agg(F.collect_set("k").alias("valid"))
    body = F.format_string("See page %d and pp. %d-%d.", "k", "k", F.col("k") + 3)
    rows = e.join(valid, "user_id", "left").select("event_id", T.clean_inline_pages(body, F.coalesce("valid", F.array().cast("array<int>"))).alias("x"))
    return rows.select("event_id", "x.body", "x.removed")


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(regexp_extract(props, '[0-9]+') AS BIGINT) END AS k FROM events")
def event_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object in a model's answer: bare, fenced behind thoughts, within prose, or cut off."""
    n, props = F.col("event_id") % 4, F.col("props")
    answer = F.when(n == 0, props).when(n == 1, F.concat(F.lit('<think>{"k": 0}</think>\n```json\n'), props, F.lit("\n```"))).when(n == 2, F.concat(F.lit("Here it is: "), props, F.lit(" as asked."))).otherwise(F.substr(props, F.lit(1), F.length(props) - 1))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(T.json_object(answer), "$.k", "bigint").alias("k"))


@query("SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN least(65.0, event_id % 100) WHEN 1 THEN least(65.0, value + 0.5) WHEN 2 THEN least(65.0, floor(value * 100) / 1000 + 0.5) ELSE 10.0 END, 6) AS seconds FROM events")
def event_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, value = F.col("event_id") % 4, F.col("value")
    header = F.when(n == 0, (F.col("event_id") % 100).cast("string"))
    message = F.when(n == 1, F.concat(F.lit("Limit reached, Try again in "), F.format_string("%.2f", value), F.lit("s."))).when(n == 2, F.concat(F.lit("try again in "), F.floor(value * 100).cast("string"), F.lit("ms"))).otherwise(F.lit("no hint"))
    return table(spark, sf_dir, "events").select("event_id", F.round(T.retry_delay(header, message), 6).alias("seconds"))


@query(r"""SELECT page_id, CASE WHEN s = '' THEN 'document' ELSE s END AS stem, CASE WHEN n < 1048576 THEN CAST(CAST(round_even(n / 1024, 0) AS BIGINT) AS VARCHAR) || ' KB' ELSE CAST(CAST(round_even(n / 1048576, 1) AS DECIMAL(20, 1)) AS VARCHAR) || ' MB' END AS size
FROM (SELECT page_id, substring(regexp_replace(regexp_replace(url, '\.pdf$', '', 'i'), '[^\p{L}\p{N}_.-]', '_', 'g'), 1, 80) AS s, strlen(html) * (1 + page_id % 500) AS n FROM pages)""")
def page_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("html") * (1 + F.col("page_id") % 500)
    return table(spark, sf_dir, "pages").select("page_id", T.export_stem(F.col("url")).alias("stem"), T.human_size(size).alias("size"))


@query("""WITH j AS (SELECT event_type AS server, user_id AS address, CASE event_id % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'error' WHEN 2 THEN 'queued' ELSE 'analyzing' END AS status FROM events),
a AS (SELECT server, address, count(*) FILTER (status NOT IN ('done', 'error')) AS active, count(*) FILTER (status = 'queued') AS waiting FROM j GROUP BY server, address)
SELECT server, CAST(sum(active) AS BIGINT) AS active, CAST(sum(waiting) AS BIGINT) AS waiting, max(active) AS busiest_address FROM a GROUP BY server""")
def server_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 5
    status = F.when(n == 0, "done").when(n == 1, "error").when(n == 2, "queued").otherwise("analyzing")
    return J.counters(table(spark, sf_dir, "events").select(F.col("event_type").alias("server"), F.col("user_id").alias("address"), status.alias("status")))
