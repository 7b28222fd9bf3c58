"""Inputs of the registered queries, derived from the given tables (Spark side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepost.functions.text import word_count

# Bins over words the test texts have, in the weights of the library's own bins.
BINS = {
    "environmental": ["with", "from the", "this"],
    "CV_autonomous_robotics": ["und", "der die"],
    "LLM_related": ["pour une", "les"],
    "geospatial_r_sensing": ["para", "los"],
    "energy": ["on", "as"],
    "coding": ["er", "en", "re"],
}
LEMMAS = [("ing", "in"), ("eaux", "eau"), ("les", "le"), ("los", "el"), ("thes", "the")]
PROFILE_LABELS = {0: "geospatial", 1: "energy", 2: "cv_robotics", 3: "llm_science"}
PROFILE_TEXT = "Data scientist for maps, sensors and power grids."
CRITERIA = "\n- Python work.\n- Remote or near the coast.\n"
AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str, labels: bool = False, companies: bool = False) -> DataFrame:
    """Documents in posting columns; label and company are joined only where they are used."""
    rows = table(spark, sf_dir, "documents")
    if labels:
        rows = rows.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    if companies:
        bench = table(spark, sf_dir, "benchmark")
        n = bench.agg(F.count("*").alias("n")).scalar()
        names = bench.select("item_id", F.split_part("text", F.lit(" "), F.lit(1)).alias("companies"))
        rows = rows.withColumn("item_id", F.col("doc_id") % n).join(names, "item_id", "left")
    columns = [F.col("doc_id").cast("string").alias("job_id"), F.col("source"),
               F.split_part("text", F.lit("\n"), F.lit(1)).alias("titles"),
               F.col("lang").alias("location"), F.col("text").alias("desc"), F.col("doc_id"),
               (F.lit("2024-01-01").cast("timestamp_ntz")
                + F.make_dt_interval(hours=(F.col("doc_id") % 720).cast("int"))).alias("posted_at")]
    if labels:
        columns += [F.coalesce("quality", F.lit(-1)).alias("label"), F.col("toxic")]
    if companies:
        columns += [F.col("companies")]
    return rows.select(*columns)


def nested_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose article is wrapped in nested blocks of one kind, with a time after them."""
    article = F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1)
    wrapped = F.concat(F.lit('<div class="x body"><div>First</div>'), article, F.lit('<div><div>Last &#233;</div></div></div>'),
                       F.lit('<div>Outside</div><time datetime="2024-01-0'), (F.col("page_id") % 9 + 1).cast("string"), F.lit('">x</time>'))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.replace("html", article, wrapped).alias("html"))


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All postings as once stored: labelled ones are scored, toxic ones lack a title."""
    p = postings(spark, sf_dir, labels=True, companies=True)
    return p.select("job_id", "source",
                    F.when(F.col("toxic") == 1, "").otherwise(F.col("titles")).alias("titles"),
                    "companies", "location", "desc", "posted_at",
                    F.when(F.col("label") >= 0, F.col("label") * 50.0 + 25.0).alias("similarity_score"),
                    F.when(F.col("label") >= 0, F.col("label") * 40.0).alias("score_energy"))


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new crawl: labelled postings again, toxic ones twice, and unseen ones from `benchmark`."""
    p = postings(spark, sf_dir, labels=True, companies=True)
    columns = ["job_id", "source", "titles", "companies", "desc", "posted_at", "scraped_at"]
    first = (p.filter("label >= 0")
             .withColumns({"source": F.lit("crawl1"), "scraped_at": F.lit(1)}).select(columns))
    second = (p.filter("toxic = 1")
              .withColumns({"source": F.lit("crawl2"), "scraped_at": F.lit(2)}).select(columns))
    unseen = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("job_id"),
        F.lit("crawl1").alias("source"), F.split_part("text", F.lit(" "), F.lit(1)).alias("titles"),
        F.lit(None).cast("string").alias("companies"), F.col("text").alias("desc"),
        F.lit("2024-01-31").cast("timestamp_ntz").alias("posted_at"), F.lit(1).alias("scraped_at"))
    return first.unionByName(second).unionByName(unseen)


def city_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting is listed in two (for some the same) cities, which overlap."""
    p = postings(spark, sf_dir)
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("city_ordinal"),
                                                   F.col("n_name").alias("query_city"))
    keyed = p.withColumn("city_ordinal", F.explode(F.array_distinct(
        F.array(F.col("doc_id") % 25, F.col("doc_id") % 7))))
    return keyed.join(nation, "city_ordinal")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four anchors: per label 0-3 the vector with the smallest id."""
    names = F.create_map(*[F.lit(x) for pair in PROFILE_LABELS.items() for x in pair])
    return (table(spark, sf_dir, "embeddings").filter(F.col("label").isin(list(PROFILE_LABELS)))
            .groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
            .select(names[F.col("label")].alias("profile"), "embedding"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled postings with a made-up classifier output that has ties."""
    p = postings(spark, sf_dir, labels=True).filter("label >= 0")
    probability = F.round(F.least(F.lit(1.0), word_count(F.col("desc")) / 1000.0), 3)
    return (p.select("job_id", "label", probability.alias("probability"))
            .withColumn("prediction", (F.col("probability") >= 0.3).cast("int")))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed rating replies out of events: some cannot be parsed, some have blanks around."""
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_id") % 5
    raw = (F.when(kind == 0, F.concat(k, F.lit("/10"))).when(kind == 1, F.concat(F.lit(" "), k, F.lit(" ")))
           .otherwise(k))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"), raw.alias("raw"),
        F.floor("value").cast("long").alias("total_tokens"))
