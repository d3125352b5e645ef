"""Hosts with ports, users and addresses, suffixes of a table, and odd rows of urls."""

from pyspark.sql import functions as F

from quaver.llm import urls


def levels(spark, hosts, suffixes=("co.uk", "b.c.d")):
    names = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", urls.host_name(F.col("host")).alias("name"))
    found = urls.with_levels(names, spark.createDataFrame([(s,) for s in suffixes], "suffix string"))
    return {r.host: (r.name, r.domain, r.suffix) for r in found.collect()}


def test_levels(spark):
    assert levels(spark, ["x.example.com:8080", "a@b@x.example.com:1", "10.0.0.1:80", "10.0.0.1", "[::1]:443", "x.y.co.uk", "co.uk", "y.co.uk", "a.b.c.d", "z.a.b.c.d", "b.c.d", "", "localhost:99", "1.2.3.4.com", "x.com."]) == {
        "x.example.com:8080": ("x.example.com", "example.com", "com"),
        "a@b@x.example.com:1": ("x.example.com", "example.com", "com"),
        "10.0.0.1:80": ("10.0.0.1",) * 3,
        "10.0.0.1": ("10.0.0.1",) * 3,
        "[::1]:443": ("[::1]",) * 3,
        "x.y.co.uk": ("x.y.co.uk", "y.co.uk", "co.uk"),
        "y.co.uk": ("y.co.uk", "y.co.uk", "co.uk"),
        "co.uk": ("co.uk", "co.uk", "co.uk"),
        "a.b.c.d": ("a.b.c.d", "a.b.c.d", "b.c.d"),
        "z.a.b.c.d": ("z.a.b.c.d", "a.b.c.d", "b.c.d"),
        "b.c.d": ("b.c.d", "b.c.d", "b.c.d"),
        "": ("", "", ""),
        "localhost:99": ("localhost",) * 3,
        "1.2.3.4.com": ("1.2.3.4.com", "4.com", "com"),
        "x.com.": ("x.com.", "com.", ""),
    }


def test_addresses_share_no_reputation(spark):
    bad, good = [(i, f"http://10.0.0.1:{i}/") for i in range(40)], [(100 + i, "http://10.0.0.2/") for i in range(40)]
    other = [(300 + i, f"http://host{i}.org/") for i in range(40)]
    new = [(900, "http://10.0.0.1/x"), (901, "http://9.9.9.9/"), (902, "http://u@10.0.0.1:5/")]
    pages = spark.createDataFrame(bad + good + other + new + [(None, "http://10.0.0.1/"), (900, "http://10.0.0.1/x"), (903, "http://" + "a" * 100_000 + ".org/")], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0, 0) for i, _ in bad] + [(i, 1, 0) for i, _ in good + other] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    got = urls.filter_urls(pages.withColumn("host", F.lit("clash")).withColumn("name", F.lit("clash")), labels).collect()
    assert len(got) == 126
    verdicts = {(r.page_id, r.host[:20]): r.verdict for r in got}
    assert verdicts[900, "10.0.0.1"] == verdicts[902, "u@10.0.0.1:5"] == verdicts[None, "10.0.0.1"] == "block"
    assert verdicts[901, "9.9.9.9"] == verdicts[100, "10.0.0.2"] == verdicts[903, "a" * 20] == "allow"


def test_suffixes_of_a_table(spark):
    """With own.net as a suffix, one bad site there says little about another."""
    pages = spark.createDataFrame([(i, "http://bad.own.net/") for i in range(60)] + [(100, "http://new.own.net/")] + [(200 + i, f"http://s{i}.com/") for i in range(60)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0, 0) for i in range(60)] + [(200 + i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    seen = pages.select(urls.host_name(urls.url_host(F.col("url"))).alias("name"), "page_id")
    outcomes = seen.join(labels.withColumnRenamed("doc_id", "page_id"), "page_id").select("name", (F.col("quality") == 0).cast("int").alias("bad"))

    def mean(*suffixes):
        table = spark.createDataFrame([(s,) for s in suffixes], "suffix string")
        posts = urls.host_posteriors(seen.select("name").distinct(), outcomes, table)
        return {r.name: r["mean"] for r in posts.collect()}["new.own.net"]

    assert mean("own.net") < mean("co.uk")
