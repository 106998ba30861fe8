"""Queries over the driver's tables that exercise the engine's operators, each with its SQL twin for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import exprs as X
from .operators import graph, series
from .plans import correlate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DAY = 86_400_000


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def timed_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


def rounded(column, digits=6):
    return F.round(column, digits)


@query("densest_window", """
    WITH w AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) ms, count(*) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000) RANGE BETWEEN CURRENT ROW AND 86400000 FOLLOWING) n FROM events),
    b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, ms, event_id) k FROM w)
    SELECT user_id, ms AS start_ms, n, CASE WHEN n >= 9 THEN 'CRITICAL' WHEN n >= 3 THEN 'HIGH' ELSE 'LOW' END AS severity FROM b WHERE k = 1""")
def densest_window(spark, d):
    best = series.densest_window(timed_events(spark, d), ["user_id"], "ms", "event_id", DAY)
    return best.withColumn("severity", F.when(F.col("n") >= 9, "CRITICAL").when(F.col("n") >= 3, "HIGH").otherwise("LOW"))


@query("pause_percentiles", """
    SELECT event_type, quantile_disc(value, 0.5) p50, quantile_disc(value, 0.95) p95, quantile_disc(value, 0.99) p99, count(*) FILTER (value > 100) n_over, max(value) worst FROM events GROUP BY event_type""")
def pause_percentiles(spark, d):
    e = table(spark, d, "events")
    over = e.groupBy("event_type").agg(F.count_if(F.col("value") > 100).alias("n_over"), F.max("value").alias("worst"))
    return series.nearest_rank(e, ["event_type"], "value", [50, 95, 99]).join(over, "event_type")


_SERIES = """WITH s AS (SELECT user_id, value, row_number() OVER w rn, lag(value) OVER w prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT user_id, count(*) n, count(*) FILTER (value < prev) dips, arg_min(value, rn) first, arg_max(value, rn) last FROM s GROUP BY user_id)"""


@query("live_set_series", _SERIES + """
    SELECT user_id, n, dips, first, last, round((last - first) / first, 6) rise, dips = 0 AS monotone, (dips <= greatest(1, 0.25 * n) AND (last - first) / first >= 0.1) AS climbing FROM g""")
def live_set_series(spark, d):
    s = series.series_shape(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value")
    climbing = (F.col("dips") <= F.greatest(F.lit(1.0), 0.25 * F.col("n"))) & (F.col("rise") >= 0.1)
    return s.withColumn("climbing", climbing).withColumn("rise", rounded("rise"))


@query("pinned_stagnant", """
    WITH c AS (SELECT max(value) cap FROM events), s AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) prev, cap FROM events, c)
    SELECT user_id, count(*) FILTER (value >= cap * 0.2) pinned, count(*) FILTER ((prev - value) / prev < 0.02) stagnant, count(*) n FROM s GROUP BY user_id""")
def pinned_stagnant(spark, d):
    e = table(spark, d, "events")
    cap = F.broadcast(e.agg(F.max("value").alias("cap")))
    w = Window.partitionBy("user_id").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))
    s = e.withColumn("prev", F.lag("value").over(w)).crossJoin(cap)  # one row
    freed = X.quotient(F.col("prev") - F.col("value"), F.col("prev"))
    return s.groupBy("user_id").agg(F.count_if(F.col("value") >= F.col("cap") * 0.2).alias("pinned"), F.count_if(freed < 0.02).alias("stagnant"), F.count(F.lit(1)).alias("n"))


@query("evenly_spaced_sample", """
    WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) rn, count(*) OVER (PARTITION BY user_id) n FROM events)
    SELECT user_id, event_id FROM s WHERE (rn - 1) % greatest(1, n // 6) = 0 OR rn = n""")
def evenly_spaced_sample(spark, d):
    return series.evenly_spaced(table(spark, d, "events"), ["user_id"], "event_id", 6).select("user_id", "event_id")


@query("throughput", """
    WITH g AS (SELECT date_trunc('day', ts)::DATE AS day, count(*) n, sum(value) stopped, (max((epoch_us(ts) // 1000)) - min((epoch_us(ts) // 1000))) / 1000.0 AS seconds FROM events GROUP BY 1)
    SELECT CAST(day AS VARCHAR) AS day, n, round(stopped, 4) stopped, round(greatest(0, 1 - stopped / (seconds * 10)), 6) AS share FROM g WHERE n >= 10 AND seconds >= 10""")
def throughput(spark, d):
    e = timed_events(spark, d).groupBy(F.col("ts").cast("date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("stopped"), ((F.max("ms") - F.min("ms")) / 1000.0).alias("seconds"))
    share = F.greatest(F.lit(0.0), 1 - F.col("stopped") / (F.col("seconds") * 10))
    return e.where("n >= 10 and seconds >= 10").select("day", "n", rounded("stopped", 4).alias("stopped"), rounded(share).alias("share"))


@query("stall_summary", """
    WITH s AS (SELECT user_id, event_id, value FROM events WHERE event_type = 'error'), f AS (SELECT user_id, min(event_id) e FROM s GROUP BY 1 ORDER BY 2 LIMIT 3)
    SELECT count(*) AS n, max(value) AS longest, round(sum(value), 4) AS total, (SELECT string_agg(CAST(user_id AS VARCHAR), ', ' ORDER BY e) FROM f) AS victims FROM s""")
def stall_summary(spark, d):
    s = table(spark, d, "events").where("event_type = 'error'")
    first = s.groupBy("user_id").agg(F.min("event_id").alias("e")).orderBy("e").limit(3)  # a report names three
    names = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("e", "user_id"))), lambda x: x["user_id"].cast("string")), ", ").alias("victims"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("longest"), rounded(F.sum("value"), 4).alias("total")).crossJoin(F.broadcast(names))


@query("low_yield", """
    SELECT l_returnflag, count(*) n, count(*) FILTER (l_discount >= 0.05 AND l_tax < 0.15 * l_discount) low, count(*) FILTER (l_quantity >= 45) humongous, bool_or(l_tax = 0.08) exhausted FROM lineitem GROUP BY l_returnflag""")
def low_yield(spark, d):
    low = (F.col("l_discount") >= 0.05) & (F.col("l_tax") < 0.15 * F.col("l_discount"))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(low).alias("low"), F.count_if(F.col("l_quantity") >= 45).alias("humongous"), F.bool_or(F.col("l_tax") == 0.08).alias("exhausted"))


NEEDLES = ["password", "copyright", "http", "license", "zzzz-none"]


@query("config_needles", " UNION ALL ".join(f"SELECT '{n}' AS needle, min(doc_id) AS first_doc, count(*) AS n FROM documents WHERE contains(lower(text), '{n}')" for n in NEEDLES))
def config_needles(spark, d):
    lower = F.lower("text")
    hits = [F.when(F.contains(lower, F.lit(n)), F.lit(n)) for n in NEEDLES]
    found = table(spark, d, "documents").select("doc_id", F.explode(F.array_compact(F.array(*hits))).alias("needle")).groupBy("needle").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"))
    known = F.broadcast(spark.createDataFrame([(n,) for n in NEEDLES], "needle string"))
    return known.join(found, "needle", "left").select("needle", "first_doc", F.coalesce("n", F.lit(0)).alias("n"))


_HISTO = """WITH h AS (SELECT p_type AS class, p_brand AS brand, sum(l_quantity) AS bytes, count(*) AS instances FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    t AS (SELECT brand, sum(bytes) total, sum(instances) n FROM h GROUP BY 1)"""


def histogram(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    items = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("k"))
    return items.join(parts, "p_partkey").groupBy(F.col("p_type").alias("class"), F.col("p_brand").alias("brand")).agg(F.sum("q").alias("bytes"), F.sum("k").alias("instances"))


@query("histo_dominance", _HISTO + """, r AS (SELECT h.*, total, row_number() OVER (PARTITION BY brand ORDER BY bytes DESC, class) k FROM h JOIN t USING (brand))
    SELECT brand, class AS leader, bytes, round(bytes / total, 6) AS share, CASE WHEN bytes / total >= 0.6 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM r WHERE k = 1""")
def histo_dominance(spark, d):
    shared = series.share_of_total(histogram(spark, d), ["brand"], "bytes")
    top = series.top_k(shared, ["brand"], [F.desc("bytes"), F.col("class")], 1)
    return top.select("brand", F.col("class").alias("leader"), "bytes", rounded("share").alias("share"), F.when(F.col("share") >= 0.6, "HIGH").otherwise("MEDIUM").alias("severity"))


@query("histo_bag", _HISTO + " SELECT brand, round(coalesce(sum(bytes) FILTER (class LIKE '%BRASS' OR class LIKE '%STEEL'), 0) / max(total), 6) AS bag_share FROM h JOIN t USING (brand) GROUP BY brand")
def histo_bag(spark, d):
    bag = F.col("class").rlike("(BRASS|STEEL)$")
    return histogram(spark, d).groupBy("brand").agg(rounded(F.coalesce(F.sum(F.when(bag, F.col("bytes"))), F.lit(0.0)) / F.sum("bytes")).alias("bag_share"))


@query("container_bar", _HISTO + " SELECT brand, class, h.instances FROM h JOIN t USING (brand) WHERE h.instances >= greatest(5, t.n / 20)")
def container_bar(spark, d):
    total = F.sum("instances").over(Window.partitionBy("brand"))
    return histogram(spark, d).withColumn("n", total).where(F.col("instances") >= F.greatest(F.lit(5.0), F.col("n") / 20)).select("brand", "class", "instances")


@query("top_bytes", _HISTO + ", r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY bytes DESC, class) AS rank FROM h) SELECT brand, class, bytes, rank FROM r WHERE rank <= 3")
def top_bytes(spark, d):
    return series.top_k(histogram(spark, d), ["brand"], [F.desc("bytes"), F.col("class")], 3).select("brand", "class", "bytes", "rank")


@query("top_instances", _HISTO + ", r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY instances DESC, class) AS rank FROM h) SELECT brand, class, instances, rank FROM r WHERE rank <= 3")
def top_instances(spark, d):
    return series.top_k(histogram(spark, d), ["brand"], [F.desc("instances"), F.col("class")], 3).select("brand", "class", "instances", "rank")


@query("name_family", """
    SELECT family, count(*) AS n, min(c_custkey) AS first FROM (SELECT c_custkey, CASE WHEN trim(f) = '' THEN c_name ELSE f END family FROM
    (SELECT c_custkey, c_name, regexp_replace(regexp_replace(c_name, '(\\D)[-_]\\d+(\\D)', '\\1-N\\2', 'g'), '[-_#]?\\d+$', '') f FROM (SELECT c_custkey, c_mktsegment || '-' || c_nationkey || '-exec-' || c_custkey AS c_name FROM customer))) GROUP BY family""")
def name_family(spark, d):
    name = F.concat("c_mktsegment", F.lit("-"), F.col("c_nationkey").cast("string"), F.lit("-exec-"), F.col("c_custkey").cast("string"))
    return table(spark, d, "customer").select("c_custkey", X.name_family(name).alias("family")).groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first"))


@query("family_growth", """
    WITH m AS (SELECT o_orderpriority AS family, strftime(o_orderdate, '%Y') AS month, count(*) n FROM orders GROUP BY 1, 2), l AS (SELECT *, lag(n) OVER (PARTITION BY family ORDER BY month) p FROM m)
    SELECT family, count(*) AS captures, coalesce(bool_and(p IS NULL OR n >= p), true) AS monotone, arg_min(n, month) AS first, arg_max(n, month) AS last, round(arg_max(n, month) / arg_min(n, month), 6) AS ratio FROM l GROUP BY family""")
def family_growth(spark, d):
    m = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("family"), F.date_format("o_orderdate", "yyyy").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    s = series.series_shape(m, ["family"], ["month"], "n")
    return s.select("family", F.col("n").alias("captures"), "monotone", "first", "last", rounded(F.col("last") / F.col("first")).alias("ratio"))


@query("lock_contention", """
    WITH w AS (SELECT o_orderpriority AS dump, o_orderstatus AS monitor, count(*) AS waiters, min(o_custkey) AS holder FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY dump ORDER BY waiters DESC, monitor) k FROM w WHERE waiters >= 3)
    SELECT dump, monitor, waiters, c_name AS holder FROM r LEFT JOIN customer ON holder = c_custkey WHERE k <= 2""")
def lock_contention(spark, d):
    w = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("dump"), F.col("o_orderstatus").alias("monitor")).agg(F.count(F.lit(1)).alias("waiters"), F.min("o_custkey").alias("c_custkey")).where("waiters >= 3")
    names = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("holder"))
    return series.top_k(w, ["dump"], [F.desc("waiters"), F.col("monitor")], 2).join(names, "c_custkey", "left").select("dump", "monitor", "waiters", "holder")


def supplier_graph(spark, d):
    """Each supplier waits for one other: key k (from 0) for (k * k + 3) mod n."""
    s = table(spark, d, "supplier")
    n = s.count()
    k = F.col("s_suppkey") - 1
    return s.select(F.lit(0).alias("dump"), k.alias("src"), ((k * k + 3) % n).alias("dst"))


_GRAPH = "WITH RECURSIVE e AS (SELECT s_suppkey - 1 AS src, ((s_suppkey - 1) * (s_suppkey - 1) + 3) % (SELECT count(*) FROM supplier) AS dst FROM supplier)"


@query("wait_graph", _GRAPH + " SELECT dst AS owner, count(*) AS waiters, min(src) AS first FROM e WHERE src <> dst GROUP BY dst")
def wait_graph(spark, d):
    return supplier_graph(spark, d).where("src <> dst").groupBy(F.col("dst").alias("owner")).agg(F.count(F.lit(1)).alias("waiters"), F.min("src").alias("first"))


@query("contended_monitors", _GRAPH + " SELECT dst AS owner, count(*) AS waiters FROM e GROUP BY dst HAVING count(*) >= 2")
def contended_monitors(spark, d):
    g = supplier_graph(spark, d).withColumn("monitor", F.col("dst"))
    return graph.contended(g, ["dump"]).select("owner", "waiters")


_REACH = _GRAPH + ", r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)"


@query("cycles", _REACH + ", c AS (SELECT a.src AS node, min(b.dst) AS cycle, count(*) AS length FROM r a JOIN r b ON a.src = b.src WHERE a.src = a.dst GROUP BY a.src) SELECT node, cycle, length FROM c")
def cycles(spark, d):
    return graph.functional_cycles(supplier_graph(spark, d), ["dump"]).select("node", "cycle", "length")


@query("strong_components", _REACH + ", p AS (SELECT DISTINCT x.src AS node, y.src AS other FROM r x JOIN r y ON x.dst = y.src AND y.dst = x.src) SELECT n.src AS node, least(n.src, coalesce(min(p.other), n.src)) AS component, greatest(1, count(p.other)) AS size FROM (SELECT src FROM e UNION SELECT dst FROM e) n LEFT JOIN p ON n.src = p.node GROUP BY n.src")
def strong_components(spark, d):
    return graph.strong_components(supplier_graph(spark, d).select("src", "dst"))


@query("stack_cluster", """
    SELECT l_returnflag || '|' || l_linestatus || ';' || CAST(l_linenumber AS VARCHAR) || ';' AS print, count(*) AS n, min(l_orderkey) AS first FROM lineitem GROUP BY 1 HAVING count(*) >= 5""")
def stack_cluster(spark, d):
    printed = F.concat("l_returnflag", F.lit("|"), "l_linestatus", F.lit(";"), F.col("l_linenumber").cast("string"), F.lit(";"))
    return table(spark, d, "lineitem").groupBy(printed.alias("print")).agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first")).where("n >= 5")


@query("pool_starved", """
    WITH p AS (SELECT c_mktsegment AS pool, c_nationkey AS place, count(*) k FROM customer GROUP BY 1, 2), t AS (SELECT pool, sum(k) n FROM p GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY k DESC, place) rn FROM p)
    SELECT pool, place, k, CAST(n AS BIGINT) AS n, round(k / n, 6) AS share FROM r JOIN t USING (pool) WHERE rn = 1""")
def pool_starved(spark, d):
    p = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("pool"), F.col("c_nationkey").alias("place")).agg(F.count(F.lit(1)).alias("k")).withColumn("n", F.sum("k").over(Window.partitionBy("pool")))
    return series.top_k(p, ["pool"], [F.desc("k"), F.col("place")], 1).select("pool", "place", "k", "n", rounded(F.col("k") / F.col("n")).alias("share"))


@query("cpu_delta", """
    WITH u AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) v FROM events GROUP BY 1, 2), b AS (SELECT user_id, arg_min(v, day) a, arg_max(v, day) b, date_diff('day', min(day), max(day)) wall FROM u GROUP BY 1), c AS (SELECT user_id, (b - a) / wall AS rate FROM b WHERE wall > 0 AND b >= a)
    SELECT user_id, round(rate, 6) AS rate, rank FROM (SELECT *, row_number() OVER (ORDER BY round(rate, 6) DESC, user_id) AS rank FROM c) WHERE rank <= 3""")
def cpu_delta(spark, d):
    u = table(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("v"))
    b = u.groupBy("user_id").agg(F.min_by("v", "day").alias("a"), F.max_by("v", "day").alias("b"), F.datediff(F.max("day"), F.min("day")).alias("wall")).where("wall > 0 and b >= a")
    rate = b.select("user_id", rounded((F.col("b") - F.col("a")) / F.col("wall")).alias("rate"), F.lit(0).alias("all"))
    return series.top_k(rate, ["all"], [F.desc("rate"), F.col("user_id")], 3).select("user_id", "rate", "rank")


_PRINT = "lang || '|' || source || '|' || regexp_extract(text, '^\\S+', 0)"


@query("exception_clusters", f"""
    WITH c AS (SELECT doc_id, n_chars, {_PRINT} AS print FROM documents) SELECT print, count(*) AS n, min(doc_id) AS first, arg_max(doc_id, n_chars * 1000000 - doc_id) AS representative FROM c GROUP BY print HAVING count(*) >= 2""")
def exception_clusters(spark, d):
    printed = F.concat("lang", F.lit("|"), "source", F.lit("|"), F.regexp_extract("text", "^\\S+", 0))
    c = table(spark, d, "documents").select("doc_id", "n_chars", printed.alias("print")).groupBy("print")
    return c.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("representative")).where("n >= 2")


@query("causal_site", """
    WITH s AS (SELECT event_type AS cls, CAST(json_extract(props, '$.k') AS INTEGER) AS site, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY n DESC, first DESC) AS rank FROM s)
    SELECT cls, site, n, rank FROM r WHERE rank <= 3 AND n >= 2""")
def causal_site(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("cls"), F.get_json_object("props", "$.k").cast("int").alias("site"))
    s = e.groupBy("cls", "site").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    return series.top_k(s, ["cls"], [F.desc("n"), F.desc("first")], 3).where("n >= 2").select("cls", "site", "n", "rank")


@query("burst", """
    WITH b AS (SELECT event_type, (epoch_us(ts) // 1000) // 86400000 AS bucket, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, bucket) k FROM b)
    SELECT event_type, bucket, n FROM r WHERE k = 1 AND n >= 10""")
def burst(spark, d):
    return series.densest_bucket(timed_events(spark, d), ["event_type"], "ms", DAY, 10)


@query("line_split", """
    WITH l AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '(\\r\\n|\\r|\\n)+$', ''), '\\r\\n|\\r|\\n') AS a FROM documents) SELECT doc_id, len(a) AS n_lines, md5(array_to_string(a, chr(10))) AS digest FROM l""")
def line_split(spark, d):
    from .sources.artifacts import lines_of

    docs = table(spark, d, "documents").select(F.lit("s").alias("snapshot_id"), F.col("doc_id").cast("string").alias("file"), F.col("doc_id").alias("ord"), F.col("text").alias("content"))
    lines = lines_of(docs).groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")).alias("digest"))
    return lines.select(F.col("file").cast("long").alias("doc_id"), "n_lines", "digest")


@query("parse_bytes", """
    SELECT doc_id, CAST(floor(n_chars * 1.5 * 1024) AS BIGINT) AS kib, CAST(n_chars AS BIGINT) * 1048576 AS mib, n_chars AS plain, CASE WHEN n_chars < 1024 THEN n_chars || ' B' ELSE printf('%.1f KB', n_chars / 1024.0 + 1e-9) END AS human FROM documents""")
def parse_bytes(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").select(
        "doc_id", X.parse_bytes(F.concat(F.format_string("%.1f", n * 1.5), F.lit("K"))).alias("kib"), X.parse_bytes(F.concat(n.cast("string"), F.lit(" MB"))).alias("mib"), X.parse_bytes(n.cast("string")).alias("plain"), X.human_bytes(n).alias("human")
    )


@query("epoch_parse", """
    SELECT event_id, (epoch_us(ts) // 1000) // 1000 * 1000 AS a, (epoch_us(ts) // 1000) AS b, (epoch_us(ts) // 1000) // 1000 * 1000 AS c, (epoch_us(ts) // 1000) // 1000 * 1000 AS ctime, (epoch_us(ts) // 1000) - 28800000 AS zoned, CAST(NULL AS BIGINT) AS bad FROM events""")
def epoch_parse(spark, d):
    t = F.col("ts").cast("timestamp")
    form = lambda f: X.epoch_millis(F.date_format(t, f))
    return table(spark, d, "events").select("event_id", form("yyyy-MM-dd HH:mm:ss").alias("a"), form("yyyy-MM-dd HH:mm:ss,SSS").alias("b"), form("yyyy/MM/dd HH:mm:ss").alias("c"), form("EEE MMM dd HH:mm:ss 'UTC' yyyy").alias("ctime"), form("yyyy-MM-dd'T'HH:mm:ss.SSS'+0800'").alias("zoned"), X.epoch_millis(F.lit("10:11:12")).alias("bad"))


@query("quote", "SELECT doc_id, CASE WHEN length(l) > 200 THEN left(l, 199) || '…' ELSE l END AS quote FROM (SELECT doc_id, rtrim(string_split(text, chr(10))[1], ' ') l FROM documents)")
def quote(spark, d):
    return table(spark, d, "documents").select("doc_id", X.quote(F.get(F.split("text", "\n"), 0)).alias("quote"))


@query("first_wins", """
    WITH r AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) k FROM documents) SELECT source, lang, min(doc_id) FILTER (k = 1) AS kept, count(*) FILTER (k > 1) AS dropped FROM r GROUP BY 1, 2""")
def first_wins(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("kept"), (F.count(F.lit(1)) - 1).alias("dropped"))


def finding_rows(spark, d):
    """Rows shaped like findings, from labels: rule and severity by id."""
    n = F.col("doc_id")
    rule = F.element_at(F.array(*[F.lit(r) for r in ("GCA001", "GCA003", "EXC001", "TDA004", "GCA002", "HIS001", "GCA006")]), (n % 7 + 1).cast("int"))
    severity = F.element_at(F.array(*map(F.lit, ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"))), (n % 5 + 1).cast("int"))
    none = F.array().cast("array<struct<file:string,start_line:int,end_line:int,quote:string,note:string>>")
    return table(spark, d, "labels").select(
        F.concat(F.lit("s"), (n % 13).cast("string")).alias("snapshot_id"), rule.alias("rule_id"), severity.alias("severity"), ((n % 90) / 100.0).alias("confidence"), F.when(n % 2 == 0, "socket-io").otherwise("stack-cluster").alias("variant"),
        F.lit("t").alias("title"), F.lit("GC_LOG").alias("artifact"), F.format_string("seen in dump%d.log", n).alias("summary"), F.array(F.lit("a")).alias("recommendations"), none.alias("evidence"),
        F.create_map(F.lit("k"), F.lit("v")).alias("metrics"), n.cast("int").alias("first_line"),
    )


_FINDINGS = """WITH f AS (SELECT 's' || (doc_id % 13) AS snapshot_id, (['GCA001','GCA003','EXC001','TDA004','GCA002','HIS001','GCA006'])[doc_id % 7 + 1] AS rule_id, doc_id % 5 AS rank, (doc_id % 90) / 100.0 AS confidence,
    CASE WHEN doc_id % 2 = 0 THEN 'socket-io' ELSE 'stack-cluster' END AS variant, doc_id FROM labels), sv AS (SELECT * FROM (VALUES (0,'CRITICAL',1.0),(1,'HIGH',0.8),(2,'MEDIUM',0.55),(3,'LOW',0.35),(4,'INFO',0.2)) t(rank, severity, score))"""


@query("dedupe_findings", _FINDINGS + ", g AS (SELECT snapshot_id, rule_id, variant, min(rank) AS rank, round(max(confidence), 6) AS confidence FROM f GROUP BY 1, 2, 3) SELECT snapshot_id, rule_id, variant, severity, confidence FROM g JOIN sv USING (rank)")
def dedupe_findings(spark, d):
    return correlate.dedupe(finding_rows(spark, d)).select("snapshot_id", "rule_id", "variant", "severity", rounded("confidence").alias("confidence"))


@query("severity_census", _FINDINGS + " SELECT s.snapshot_id, sv.severity, sv.rank, count(f.doc_id) AS n FROM (SELECT DISTINCT snapshot_id FROM f) s CROSS JOIN sv LEFT JOIN f ON f.snapshot_id = s.snapshot_id AND f.rank = sv.rank GROUP BY 1, 2, 3")
def severity_census(spark, d):
    return correlate.severity_census(finding_rows(spark, d))


@query("finding_order", _FINDINGS + " SELECT snapshot_id, doc_id, row_number() OVER (PARTITION BY snapshot_id ORDER BY rank, confidence DESC, rule_id, doc_id) AS place FROM f")
def finding_order(spark, d):
    w = Window.partitionBy("snapshot_id").orderBy(correlate.rank_of("severity"), F.desc("confidence"), "rule_id", "first_line")
    return finding_rows(spark, d).select("snapshot_id", F.col("first_line").cast("long").alias("doc_id"), F.row_number().over(w).alias("place"))


_SCORE = _FINDINGS + """, h AS (SELECT * FROM (VALUES ('H-HEAP-LEAK',1,0.96,'GCA003',NULL),('H-DOWNSTREAM-IO',5,0.84,'TDA004','socket-io'),('H-WAITING-PLACE',6,0.80,'TDA004','stack-cluster'),('H-ERROR-DRIVER',7,0.82,'EXC001',NULL),
    ('H-ALLOCATION-STORM',8,0.74,'GCA001',NULL),('H-HEAP-SHAPE',9,0.76,'HIS001',NULL),('H-GC-SLOWDOWN',12,0.60,'GCA001',NULL),('H-GC-SLOWDOWN',12,0.60,'GCA006',NULL),('H-PAUSE-TUNING',13,0.56,'GCA002',NULL)) t(hypothesis, decl, weight, rule_id, wants)),
    m AS (SELECT snapshot_id, hypothesis, decl, weight, min(rank) AS rank, max(confidence) AS conf, count(DISTINCT rule_id) AS n FROM f JOIN h USING (rule_id) WHERE wants IS NULL OR wants = variant GROUP BY 1, 2, 3, 4),
    a AS (SELECT snapshot_id, hypothesis, min(rank) AS a_rank, max(confidence) AS a_conf FROM f JOIN (SELECT DISTINCT hypothesis, rule_id FROM h) USING (rule_id) GROUP BY 1, 2), k AS (SELECT snapshot_id, bool_or(rule_id = 'GCA003') AS leak FROM f GROUP BY 1),
    s AS (SELECT m.snapshot_id, m.hypothesis, decl, CASE WHEN leak AND m.hypothesis IN ('H-ALLOCATION-STORM','H-GC-SLOWDOWN','H-PAUSE-TUNING') THEN 0.55 ELSE 1.0 END::DOUBLE AS penalty,
    (score::DOUBLE * 0.4::DOUBLE + weight::DOUBLE * 0.4::DOUBLE + least(3.0, n - 1.0)::DOUBLE * 0.05::DOUBLE + a_conf::DOUBLE * 0.12::DOUBLE + conf::DOUBLE * 0.08::DOUBLE) AS raw FROM m JOIN a USING (snapshot_id, hypothesis) JOIN k USING (snapshot_id) JOIN sv ON a.a_rank = sv.rank)"""


@query("hypothesis_score", _SCORE + " SELECT snapshot_id, hypothesis, round(raw * penalty, 6) AS score, penalty, row_number() OVER (PARTITION BY snapshot_id ORDER BY round(raw * penalty, 9) DESC, decl) AS place FROM s")
def hypothesis_score(spark, d):
    return correlate.hypotheses(finding_rows(spark, d)).select("snapshot_id", "hypothesis", "score", "penalty", "place")


@query("timeline_axis", """
    WITH b AS (SELECT user_id, min((epoch_us(ts) // 1000)) boot FROM events GROUP BY 1) SELECT event_id, round(((epoch_us(ts) // 1000) - boot) / 1000.0, 6) AS sort_key, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS place FROM events JOIN b USING (user_id)""")
def timeline_axis(spark, d):
    e = timed_events(spark, d)
    w = Window.partitionBy("user_id")
    return e.select("event_id", rounded((F.col("ms") - F.min("ms").over(w)) / 1000.0).alias("sort_key"), F.row_number().over(w.orderBy("ms", "event_id")).alias("place"))
