"""Inputs that Spark derives from the given tables (FIXTURES.md §3).

File-format round trips write a table out with Spark into the shared
checkpoint folder and read it back with the matching reader; the derived
tables are deterministic functions of the inputs, written once per input
location (a ``_SUCCESS`` marker makes the write idempotent).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import derived_path, fs_exists, fs_touch
from quarry.sources.tables import load


DONE_MARKER = "_QUARRY_DONE"


def _once(spark: SparkSession, name: str, sf: str, writer) -> str:
    """Write a derived table once; a marker written after the last write
    (through the Hadoop FileSystem API, so any shared store works) makes a
    half-written folder be rewritten instead of read."""
    path = derived_path(spark, name, sf)
    marker = path + "/" + DONE_MARKER
    if not fs_exists(spark, marker):
        writer(path)
        fs_touch(spark, marker)
    return path


def dirty_price(price, key):
    """csv_dirty rule on ``l_orderkey % 100``: 1 -> '$1,234.50', 2 -> 'n/a',
    3 -> '' (empty), otherwise the plain number; 4 -> the row is doubled."""
    m = F.pmod(key, F.lit(100))
    return (F.when(m == 1, F.concat(F.lit("$"), F.format_number(price, 2)))
             .when(m == 2, F.lit("n/a")).when(m == 3, F.lit(""))
             .otherwise(price.cast("string")))


def csv_dirty_path(spark: SparkSession, sf: str) -> str:
    def write(path):
        li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity",
                                                 "l_extendedprice", "l_shipdate")
        rows = li.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity",
                         dirty_price(F.col("l_extendedprice"), F.col("l_orderkey")).alias("l_extendedprice"),
                         F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate"))
        dup = rows.filter(F.pmod("l_orderkey", F.lit(100)) == 4)
        rows.unionByName(dup).write.mode("overwrite").option("header", True).csv(path)
    return _once(spark, "csv_dirty", sf, write)


def tsv_part_path(spark: SparkSession, sf: str) -> str:
    def write(path):
        (load(spark, sf, "part").write.mode("overwrite").option("header", True).option("sep", "\t").csv(path))
    return _once(spark, "tsv_part", sf, write)


def json_array_docs_path(spark: SparkSession, sf: str, rows_per_doc: int = 5000) -> str:
    """Orders as whole-file JSON arrays, one document per hash bucket.

    The bucket count grows with the table (rows / rows_per_doc), so every
    document - and every collect in the writer - stays bounded.
    """
    def write(path):
        o = load(spark, sf, "orders")
        n = o.count()
        buckets = max(1, -(-n // rows_per_doc))
        doc = (o.select(F.pmod(F.xxhash64("o_orderkey"), F.lit(buckets)).alias("bucket"),
                        F.to_json(F.struct(*[F.col(c) for c in o.columns])).alias("js"))
               .groupBy("bucket").agg(F.concat(F.lit("["), F.array_join(F.collect_list("js"), ","), F.lit("]"))
                                      .alias("value")))
        doc.repartition("bucket").write.mode("overwrite").partitionBy("bucket").text(path)
    return _once(spark, "json_docs", sf, write)


def jsonl_events_path(spark: SparkSession, sf: str) -> str:
    def write(path):
        from quarry.sources.files import write_json_lines
        write_json_lines(load(spark, sf, "events"), path)
    return _once(spark, "jsonl_events_us", sf, write)


def latin1_documents_path(spark: SparkSession, sf: str) -> str:
    def write(path):
        from quarry.sources.files import write_json_lines
        write_json_lines(load(spark, sf, "documents").select("doc_id", "lang", "text"), path, encoding="ISO-8859-1")
    return _once(spark, "latin1_docs", sf, write)


def utf16_orders_path(spark: SparkSession, sf: str, rows_per_doc: int = 5000) -> str:
    """The JSON array documents of the orders, one file each, in UTF-16 with a byte order mark."""
    def write(path):
        fs, base = _arrow_fs_path(path)
        fs.create_dir(base, recursive=True)
        docs = spark.read.option("wholetext", True).text(json_array_docs_path(spark, sf, rows_per_doc))

        def put(batches):
            import pandas as pd
            fs, base = _arrow_fs_path(path)
            for pdf in batches:
                for value, bucket in zip(pdf["value"], pdf["bucket"]):
                    with fs.open_output_stream(f"{base}/doc-{bucket}.json") as out:
                        out.write(value.encode("utf-16"))
                yield pd.DataFrame({"n": [len(pdf)]})

        docs.mapInPandas(put, "n long").write.format("noop").mode("overwrite").save()
    return _once(spark, "utf16_orders", sf, write)


def mixed_folder(spark: SparkSession, sf: str) -> str:
    """One file of each nation, of a type that its key chooses: csv, json, txt or html."""
    def write(path):
        n = load(spark, sf, "nation")
        ext = F.get(F.array(*[F.lit(x) for x in ("csv", "json", "txt", "html")]), (F.col("n_nationkey") % 4).cast("int"))
        fs, base = _arrow_fs_path(path)
        fs.create_dir(base, recursive=True)

        def put(batches):
            import pandas as pd
            fs, base = _arrow_fs_path(path)
            for pdf in batches:
                for key, ext, name in zip(pdf["n_nationkey"], pdf["ext"], pdf["n_name"]):
                    with fs.open_output_stream(f"{base}/nation-{key}.{ext}") as out:
                        out.write(name.encode())
                yield pd.DataFrame({"n": [len(pdf)]})

        n.select("n_nationkey", "n_name", ext.alias("ext")).mapInPandas(put, "n long").write.format("noop").mode("overwrite").save()
    return _once(spark, "mixed_folder", sf, write)


def text_documents_path(spark: SparkSession, sf: str) -> str:
    def write(path):
        load(spark, sf, "documents").select("text").write.mode("overwrite").text(path)
    return _once(spark, "text_docs", sf, write)


def xml_nation_path(spark: SparkSession, sf: str) -> str:
    def write(path):
        (load(spark, sf, "nation").write.mode("overwrite").format("xml")
         .option("rowTag", "nation").option("rootTag", "nations").save(path))
    return _once(spark, "xml_nation", sf, write)


def result_runs_path(spark: SparkSession, sf: str) -> str:
    """One result.json per 'run' (order priority): the S17 input layout."""
    def write(path):
        o = load(spark, sf, "orders")
        res = o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"),
                                               F.round(F.sum("o_totalprice"), 2).alias("total"))
        res.repartition("o_orderpriority").write.mode("overwrite").partitionBy("o_orderpriority").json(path)
    return _once(spark, "result_runs", sf, write)


def damaged_runs_path(spark: SparkSession, sf: str) -> str:
    """As ``result_runs_path``, but one run's file ends in the middle, and every run folder also
    holds its result as text."""
    def write(path):
        o = load(spark, sf, "orders")
        res = o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
        js = F.to_json(F.struct("n_orders", "total"))
        text = F.when(F.col("o_orderpriority").startswith("3"), F.expr("substring(to_json(struct(n_orders, total)), 1, 20)")).otherwise(js)
        res.select(F.concat(F.lit("run-"), F.substring("o_orderpriority", 1, 1)).alias("run"), text.alias("value")) \
            .repartition("run").write.mode("overwrite").partitionBy("run").text(path)
    return _once(spark, "damaged_runs", sf, write)


# ------------------------------------------------------------------ graphs


def graph_sparse(spark: SparkSession, sf: str) -> DataFrame:
    """Every line item as an edge between its order ('o' + key) and its part ('p' + key)."""
    keys = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return keys.select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))


def graph_forest(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer linked with its nation and every order with its customer: one component per
    nation, whose nation is a hub that grows with the table."""
    def node(prefix, key):
        return F.concat(F.lit(prefix), key)
    c = load(spark, sf, "customer").select(node("c", "c_custkey").alias("src"), node("n", "c_nationkey").alias("dst"))
    o = load(spark, sf, "orders").select(node("c", "o_custkey").alias("src"), node("o", "o_orderkey").alias("dst"))
    return c.unionByName(o)


def graph_dense(spark: SparkSession, sf: str) -> DataFrame:
    """Unordered pairs of the users of consecutive events in (ts, event_id) order, self pairs
    dropped. The previous event of every row comes from a range-partitioned lag (see
    ``prefix.previous_row``), not a global window."""
    from quarry.plans.prefix import previous_row
    ev = load(spark, sf, "events").select("ts", "event_id", "user_id")
    pairs = previous_row(ev, ["ts", "event_id"], "user_id", "prev_user")
    e = pairs.filter(F.col("prev_user").isNotNull() & (F.col("prev_user") != F.col("user_id")))
    return e.select(F.least("user_id", "prev_user").alias("src"), F.greatest("user_id", "prev_user").alias("dst")).distinct()


# ------------------------------------------------------------------ pages


def pages_synth(spark: SparkSession, sf: str, suppliers_per_page: int = 50) -> DataFrame:
    """Synthetic HTML pages with known tables (the oracle is the source rows).

    One page per (region, block of ``suppliers_per_page`` supplier keys):
    a caption + header + one row per nation of the region (class
    wikitable), a plain table of the block's suppliers in that region, a
    2-row layout table, plus sup / a / script / nav / comment noise. The
    page count grows with the supplier table while every page (and every
    per-page string aggregate) stays bounded.
    """
    region = load(spark, sf, "region")
    nation = load(spark, sf, "nation")
    supplier = load(spark, sf, "supplier")
    nat_rows = nation.select("n_regionkey", "n_nationkey", F.format_string(
        '<tr><td>%d</td><td><a href="/n/%d">%s</a><sup class="reference">[%d]</sup></td><td>%d</td></tr>',
        "n_nationkey", "n_nationkey", "n_name", "n_nationkey", "n_regionkey").alias("tr"))
    nat = nat_rows.groupBy("n_regionkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "tr"))), lambda s: s["tr"]), "")
        .alias("nation_rows"))
    sup_rows = (supplier.join(F.broadcast(nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")),
                              "s_nationkey")
                .select("n_regionkey", F.floor(F.col("s_suppkey") / suppliers_per_page).alias("block"), "s_suppkey",
                        F.format_string("<tr><td>%d</td><td>%s</td><td>%.2f</td></tr>",
                                        "s_suppkey", "s_name", "s_acctbal").alias("tr")))
    sup = sup_rows.groupBy("n_regionkey", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "tr"))), lambda s: s["tr"]), "")
        .alias("supplier_rows"))
    page = (sup.join(F.broadcast(region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name")), "n_regionkey")
            .join(F.broadcast(nat), "n_regionkey", "left"))
    html = F.concat(
        F.lit("<html><head><title>"), F.col("r_name"), F.lit(" nations</title><script>var x = '<table>';</script>"
                                                            '</head><body><nav><a href="/">home</a></nav><!-- generated -->'),
        F.lit('<table class="wikitable sortable"><caption>Nations of '), F.col("r_name"),
        F.lit("</caption><tr><th>Rank</th><th>Name</th><th>Region</th></tr>"), F.coalesce("nation_rows", F.lit("")),
        F.lit("</table><table><tr><th>Key</th><th>Supplier</th><th>Balance</th></tr>"),
        F.coalesce("supplier_rows", F.lit("")),
        F.lit("</table><table><tr><td>left</td><td>right</td></tr><tr><td>a</td><td>b</td></tr></table>"
              "<footer>footer text</footer></body></html>"))
    pid = (F.col("block") * 10 + F.col("n_regionkey")).cast("bigint")
    return page.select(pid.alias("page_id"), F.col("n_regionkey").cast("bigint").alias("region_key"),
                       F.col("block").cast("bigint").alias("block"),
                       F.concat(F.lit("https://example.org/region/"), F.col("n_regionkey"), F.lit("/"), F.col("block"))
                       .alias("url"), html.alias("html"))


def pages_varied(spark: SparkSession, sf: str) -> DataFrame:
    """One page per supplier (page_id = its key k), whose parts the key chooses:

    - no tables if 11 divides k, the main table twice if 8 does, else once;
    - main table by k mod 5: a captioned wikitable, a sortable one, one with a keyword in its
      caption, one with film headers, a bare one; 3 + k mod 30 data rows (bare: k mod 3), a row
      with a nested table (one row if k is even, three rows if k mod 4 is 1), two rows with spans;
    - k mod 6: 1 a content div with a keyword, 2 one without, 3 the tables inside an article div;
    - a form if 7 divides k, a script if 3 does, a navigation box with a table if k mod 13 is 0
      (a page that names wikipedia.org) or 1 (one that does not).
    """
    k = F.col("s_suppkey")

    def by(m, *cases):
        out = F.when(F.lit(False), "")
        for r, text in cases:
            out = out.when(k % m == r, text)
        return out

    data = F.array_join(F.transform(
        F.expr("case when s_suppkey % 5 = 4 then sequence(0, s_suppkey % 3) else sequence(0, 3 + s_suppkey % 30) end"),
        lambda i: F.when(i == 0, "").otherwise(F.concat(F.lit("<tr><td>"), i, F.lit("</td><td>Item "), i, F.lit(" of "), F.col("s_name"),
                                                       F.lit("</td><td>$"), i, F.lit(",000</td></tr>")))), "")
    nested = F.when(k % 2 == 0, "<table><tr><td>x</td><td>y</td></tr></table>").when(
        k % 4 == 1, "<table>" + "<tr><td>u</td><td>v</td></tr>" * 3 + "</table>").otherwise("none")
    end = F.when(k % 9 == 0, "Titanic").otherwise("end")
    abc = "<tr><th>A</th><th>B</th><th>C</th></tr>"
    head = by(5, (0, '<table class="wikitable"><caption>Highest grossing films</caption><tr><th>Rank</th><th>Title</th><th>Gross</th></tr>'),
              (1, '<table class="sortable">' + abc), (2, "<table><caption>sales overview</caption>" + abc),
              (3, "<table><tr><th>Rank</th><th>Peak</th><th>Title</th><th>Worldwide</th><th>Year</th></tr>"), (4, "<table>"))
    main = F.concat(head, data, F.lit("<tr><td>n</td><td>o</td><td>"), nested, F.lit('</td></tr><tr><td rowspan="2">'), end,
                    F.lit('</td><td colspan="2">both</td></tr><tr><td>p<sup>1</sup></td><td><a href="/q">q</a></td></tr></table>'))
    tables = F.when(k % 11 == 0, "<p>no rows</p>").when(k % 8 == 0, F.concat(main, main)).otherwise(main)
    box = '<div class="navbox"><table><tr><td>nav</td></tr></table></div>'
    html = F.concat(
        F.lit("<html><head><title>Supplier "), k, F.lit("</title></head><body>"),
        F.when(k % 3 == 0, "<script>let a = 1;</script>").otherwise(""), F.when(k % 7 == 0, '<form action="/s"></form>').otherwise(""),
        F.when(k % 13 == 0, "<p>from wikipedia.org</p>").otherwise(""),
        F.when(k % 6 == 1, '<div class="main-content">Results of the supplier</div>')
        .when(k % 6 == 2, '<div class="content">nothing here</div>').when(k % 6 == 3, '<div class="article">Overview ').otherwise(""),
        tables, F.when(k % 6 == 3, "</div>").otherwise(""), F.when(k % 13 < 2, box).otherwise(""), F.lit("</body></html>"))
    return load(spark, sf, "supplier").select(k.alias("page_id"), F.col("s_name"), html.alias("html"))


def html_files_dir(spark: SparkSession, sf: str) -> str:
    """The synthetic pages as one .html file per page (page_id=N/part-*.txt)."""
    def write(path):
        pages = pages_synth(spark, sf)
        pages.repartition("page_id").select("page_id", "html").write.mode("overwrite").partitionBy("page_id").text(path)
    return _once(spark, "html_files", sf, write)


# ------------------------------------------------------------------ questions

# What a question of each kind ends with; the row's id chooses, so that every rule of the
# question operators decides somewhere.
QUESTION_PARTS = [
    "", "\nFind the shortest path, degree and density of the network graph.",
    "\nCompute the median, variance and correlation; is the mean normal?",
    "\nShow the trend over time, a moving average and a forecast by date.",
    "\nScrape the website https://data.example.com/films?page=2 and parse the html table.",
    "\n1. First ask\n 2. Then answer\n- `edge_count`: number\n- density: number",
    "\nSELECT a FROM b WHERE c, read_parquet('s3://bucket/key.parquet')",
    "\nHow many movies grossed over 2 bn by country and population?",
    "\nInstall httpfs; load httpfs; update and insert into the csv",
    "\ncss selector, chi-square and the time series of a stock price",
    "\nnothing to see",
]


def questions_synth(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Every row of ``df`` with the part that ``key mod n`` chooses at the end of its text."""
    parts = F.array(*[F.lit(p) for p in QUESTION_PARTS])
    return df.withColumn(text, F.concat(F.coalesce(text, F.lit("")), parts[F.pmod(F.expr(key), F.lit(len(QUESTION_PARTS))).cast("int")]))


def questions_sql(table: str, key: str, text: str = "text") -> str:
    """The same rows in SQL, to stand in the place of the table."""
    lit = ", ".join("replace('" + p.replace("'", "''").replace("\n", "~") + "', '~', chr(10))" for p in QUESTION_PARTS)
    return f"(SELECT * REPLACE (coalesce({text}, '') || [{lit}][({key}) % {len(QUESTION_PARTS)} + 1] AS {text}) FROM {table})"


# ------------------------------------------------------------------ JSON


def json_synth(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON document per customer, shape chosen by ``c_custkey % 5``:
    0 nested object (customer -> nation -> region), 1 list of objects,
    2 list of scalars, 3 dict of lists, 4 broken (truncated) text."""
    c = load(spark, sf, "customer")
    n = load(spark, sf, "nation")
    r = load(spark, sf, "region")
    j = (c.join(F.broadcast(n.select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")), "c_nationkey")
         .join(F.broadcast(r.select(F.col("r_regionkey").alias("n_regionkey"), "r_name")), "n_regionkey"))
    nested = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                                F.col("c_acctbal").alias("balance"),
                                F.struct(F.col("n_name").alias("name"),
                                         F.struct(F.col("r_name").alias("name")).alias("region")).alias("nation")))
    listing = F.to_json(F.array(F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")),
                                F.struct(F.col("c_nationkey").alias("id"), F.col("n_name").alias("segment"))))
    scalars = F.to_json(F.array(F.col("c_custkey"), F.col("c_nationkey"), F.col("n_regionkey").cast("bigint")))
    dict_lists = F.to_json(F.struct(F.array(F.col("c_custkey"), F.col("c_nationkey")).alias("keys"),
                                    F.array(F.col("c_mktsegment")).alias("segments")))
    m = F.pmod(F.col("c_custkey"), F.lit(5))
    js = (F.when(m == 0, nested).when(m == 1, listing).when(m == 2, scalars).when(m == 3, dict_lists)
           .otherwise(F.expr("substring(to_json(named_struct('id', c_custkey, 'name', c_name)), 1, 20)")))
    return j.select(F.col("c_custkey").alias("id"), js.alias("js"))



# ------------------------------------------------------------------ streams


def _time_chunks(df: DataFrame, ts: str, n: int) -> list[DataFrame]:
    """Split rows into n consecutive event-time ranges (bounds from
    approximate quantiles: n - 1 scalars reach the driver)."""
    qs = df.select(F.unix_micros(F.col(ts).cast("timestamp")).cast("double").alias("_t")) \
           .approxQuantile("_t", [i / n for i in range(1, n)], 0.001)
    t = F.unix_micros(F.col(ts).cast("timestamp")).cast("double")
    edges = [None] + qs + [None]
    out = []
    for lo, hi in zip(edges[:-1], edges[1:]):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (t >= lo)
        if hi is not None:
            cond = cond & (t < hi)
        out.append(df.filter(cond))
    return out


def events_stream_dir(spark: SparkSession, sf: str, files: int = 8) -> str:
    """events as a file stream source: files written one after another in
    event-time order, so arrival order follows event time."""
    def write(path):
        ev = load(spark, sf, "events")
        for i, chunk in enumerate(_time_chunks(ev, "ts", files)):
            chunk.write.mode("overwrite" if i == 0 else "append").parquet(path)
    return _once(spark, "events_stream", sf, write)


def perf_level(user_id):
    return F.when(F.pmod(user_id, F.lit(2)) == 0, F.lit("Optimized")).otherwise(F.lit("Fallback"))


def run_log_dir(spark: SparkSession, sf: str, files: int = 8) -> str:
    """Run-log lines derived from events, one per event:
    'YYYY-MM-DD HH:MM:SS | INFO | runner | monitor:1 | PERFORMANCE | req-<id> |
    <Optimized|Fallback> execution: <value>s' (level by user_id parity)."""
    def write(path):
        ev = load(spark, sf, "events")
        line = F.format_string("%s | INFO     | runner | monitor:1 | PERFORMANCE | req-%d | %s execution: %.2fs",
                               F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("event_id"),
                               perf_level(F.col("user_id")), F.col("value"))
        for i, chunk in enumerate(_time_chunks(ev, "ts", files)):
            chunk.select(line.alias("value")).write.mode("overwrite" if i == 0 else "append").text(path)
    return _once(spark, "run_log", sf, write)


# ------------------------------------------------------------------ archives


def _arrow_fs_path(uri: str):
    """pyarrow filesystem + path for a Spark/Hadoop style URI (file:, s3a:, ...)."""
    import pyarrow.fs as pafs
    if uri.startswith("file:") and not uri.startswith("file:///"):
        uri = "file://" + uri[len("file:"):]
    if uri.startswith("s3a://"):
        uri = "s3://" + uri[len("s3a://"):]
    if "://" not in uri:
        uri = "file://" + uri
    return pafs.FileSystem.from_uri(uri)


def zip_archives_dir(spark: SparkSession, sf: str, per_archive: int = 500) -> str:
    """Customer listings as ZIP archives, one per block of ``per_archive``
    customer keys: a 'lists/customers.csv' member (directory prefix to be
    flattened), a 'notes.txt' member, a hidden '.meta' member and a
    directory entry. Built by ``applyInPandas`` per block (bounded groups)
    and written into the shared folder through ``pyarrow.fs``."""
    def write(path):
        import io
        import zipfile

        import pandas as pd
        root = path

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("c_custkey")
            block = int(pdf["block"].iloc[0])
            body = "c_custkey,c_name,n_name\n" + "".join(
                f"{k},{n},{m}\n" for k, n, m in zip(pdf["c_custkey"], pdf["c_name"], pdf["n_name"]))
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
                zf.writestr("lists/", "")
                zf.writestr("lists/customers.csv", body)
                zf.writestr("notes.txt", f"block {block}\n")
                zf.writestr(".meta", "hidden")
            fs, base = _arrow_fs_path(root)
            fs.create_dir(base, recursive=True)
            with fs.open_output_stream(f"{base}/block={block}.zip") as out:
                out.write(buf.getvalue())
            return pd.DataFrame({"block": [block], "n": [len(pdf)]})

        c = load(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
        n = F.broadcast(load(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))
        rows = c.join(n, "c_nationkey").withColumn("block", F.floor(F.col("c_custkey") / per_archive).cast("bigint"))
        rows.groupBy("block").applyInPandas(build, "block long, n long").write.format("noop").mode("overwrite").save()
    return _once(spark, "zip_archives", sf, write)
