"""Sources, sinks and streams: each query writes a table, reads it again and returns what came back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandemtext.functions import text as T
from tandemtext.plans.base import Registry, space_words, texts
from tandemtext.session import scratch as _path
from tandemtext.sources import files
from tandemtext.sources.tables import table
from tandemtext.streaming import append

R = Registry()


@R.add("SELECT doc_id, CASE WHEN text IN ('', 'NA', 'N/A', 'null', 'NULL', 'None', 'nan', 'NaN') THEN NULL ELSE text END AS text, source FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[\\r\\x00]')")
def src01_snk01_csv(spark, d):
    path = _path(spark, "csv")
    docs = table(spark, d, "documents").select("doc_id", "text", "source").where(F.col("text").isNotNull() & ~F.rlike("text", F.lit(r"[\r\x00]")))
    files.write_csv(docs, path)
    return files.read_csv(spark, path, "doc_id long, text string, source string")


@R.add("SELECT doc_id, lang FROM documents")
def src02_csv_columns(spark, d):
    path = _path(spark, "csv")
    files.write_csv(table(spark, d, "documents").select("doc_id", "source", F.coalesce("lang", F.lit("NA")).alias("lang"), "n_chars"), path)
    return files.read_csv(spark, path, "doc_id long, source string, lang string, n_chars long", ["doc_id", "lang", "absent"])


@R.add("SELECT item_id, coalesce(nullif(text, ''), topic) AS body FROM held_out")
def src06_snk07_jsonl(spark, d):
    path = _path(spark, "jsonl")
    table(spark, d, "held_out").select("item_id", "text", "topic").write.json(path)
    return files.read_jsonl(spark, path, "item_id long, text string, topic string", ("text", "topic")).select("item_id", "body")


@R.add("SELECT DISTINCT regexp_extract(text, '^([A-Z][a-z]+)', 1) AS part FROM held_out WHERE regexp_matches(text, '^[A-Z][a-z]+')")
def src07_src15_whole_text(spark, d):
    path = _path(spark, "text")
    table(spark, d, "held_out").select(F.concat(F.lit("<<"), F.replace("text", F.lit("\n"), F.lit(" "))).alias("value")).write.text(path)
    return files.extract(files.read_whole(spark, path), r"(?m)^<<([A-Z][a-z]+)").distinct()


@R.add(f"SELECT doc_id FROM documents WHERE category IS NOT NULL AND lower(trim(category)) = 'email' AND {space_words('text')} >= 40")
def src11_email_corpus(spark, d):
    return table(spark, d, "documents").where((F.lower(F.trim("category")) == "email") & (T.space_words(F.col("text")) >= 40)).select("doc_id")


def _corpus(spark, d, name: str, most: int):
    """Non-empty texts of one corpus, up to its quota (the feature of these sources)."""
    return table(spark, d, "documents").where((F.col("text") != "") & F.col("source").startswith(name)).select("doc_id").orderBy("doc_id").limit(most)


@R.add("SELECT doc_id FROM documents WHERE text <> '' AND starts_with(source, 'essay') ORDER BY doc_id LIMIT 6000")
def src08_essay_corpus(spark, d):
    return _corpus(spark, d, "essay", 6000)


@R.add("SELECT doc_id FROM documents WHERE text <> '' AND starts_with(source, 'report') ORDER BY doc_id LIMIT 5000")
def src10_report_corpus(spark, d):
    return _corpus(spark, d, "report", 5000)


@R.add("SELECT doc_id FROM documents WHERE text <> '' AND starts_with(source, 'blog') ORDER BY doc_id LIMIT 6000")
def src12_blog_corpus(spark, d):
    return _corpus(spark, d, "blog", 6000)


@R.add("SELECT 'AI Text' AS ai, 'Human Text' AS human")
def src17_resolve_columns(spark, d):
    df = table(spark, d, "final_scored")
    return spark.createDataFrame([(files.resolve(df, files.AI_NAMES), files.resolve(df, files.HUMAN_NAMES))], "ai string, human string")


@R.add(f"SELECT CASE WHEN coalesce({space_words('text')} >= 40, false) THEN 'accepted' ELSE 'rejected' END AS outcome, count(*) AS n FROM documents GROUP BY 1")
def snk10_outputs(spark, d):
    path = _path(spark, "outcomes")
    files.write_split(texts(spark, d), path, T.space_words(F.col("text")) >= 40)
    return spark.read.parquet(path).groupBy("outcome").agg(F.count("*").alias("n"))


@R.add("SELECT count(DISTINCT coalesce(text, '<null>')) AS n FROM documents")
def stream_resumable_append(spark, d):
    """Append through a stream in two runs over the same checkpoint; the second finds nothing new."""
    out, check = _path(spark, "appended"), _path(spark, "position")
    source = table(spark, d, "documents").select("doc_id", "text")
    path = _path(spark, "incoming")
    source.write.parquet(path)
    append.append_new(spark, path, source.schema, "text", out, check)
    return append.append_new(spark, path, source.schema, "text", out, check).agg(F.count("*").alias("n"))


@R.add("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_event_counts(spark, d):
    path, out, check = _path(spark, "events"), _path(spark, "counts"), _path(spark, "position")
    source = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    source.write.parquet(path)
    return append.counts_by_window(spark, path, source.schema, "ts", "event_type", out, check)


@R.add("SELECT doc_id::VARCHAR AS first, source AS second, category AS third FROM documents WHERE source IS NOT NULL AND category IS NOT NULL AND trim(category) = category")
def src03_positional_csv(spark, d):
    """Fields by position from files without a schema; lines with fewer than three fields are left out."""
    path = _path(spark, "positional")
    files.write_csv(table(spark, d, "documents").select("doc_id", "source", "category").where("source IS NOT NULL AND category IS NOT NULL AND trim(category) = category"), path)
    raw = spark.read.schema("_c0 string, _c1 string, _c2 string").options(**files.CSV).csv(path)
    return raw.where("_c2 IS NOT NULL").toDF("first", "second", "third")


# The corpus names a text by category, number and, where it is part of one, '@' with the part.
_ACAD = "left(lower(trim(category)), 4) || '_' || doc_id || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '@chunk' || doc_id % 7 ELSE '@human' END"


@R.add(f"SELECT doc_id, name FROM (SELECT doc_id, text, {_ACAD} AS name FROM documents) WHERE starts_with(name, 'acad_') AND (contains(name, '@chunk') OR NOT contains(name, '@')) AND text <> '' ORDER BY doc_id LIMIT 6000")
def src09_academic_corpus(spark, d):
    part = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("@chunk"), (F.col("doc_id") % 7).cast("string"))).otherwise("@human")
    name = F.concat(F.left(F.lower(F.trim("category")), F.lit(4)), F.lit("_"), F.col("doc_id").cast("string"), part)
    docs = table(spark, d, "documents").select("doc_id", "text", name.alias("name"))
    return docs.where(files.academic_part(F.col("name")) & (F.col("text") != "")).select("doc_id", "name").orderBy("doc_id").limit(6000)


@R.add("SELECT * FROM (VALUES ('essay', 'One should note that it rained.', 'It rained.'), ('email', 'I am writing to inform you of a delay.', 'We are late.')) AS t(category, ai, human)")
def src14_literal_pairs(spark, d):
    return spark.createDataFrame([("essay", "One should note that it rained.", "It rained."), ("email", "I am writing to inform you of a delay.", "We are late.")], "category string, ai string, human string")


@R.add()
def snk08_snk09_report(spark, d):
    """A grouped report as Markdown, one row."""
    from tandemtext.plans.report_queries import a01_value_counts

    return spark.createDataFrame([(files.markdown(a01_value_counts(spark, d).orderBy("category")),)], "report string")


@R.add(
    "WITH g AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), r AS (SELECT source, row_number() OVER (ORDER BY md5(source || '|42'), source) AS rank, count(*) OVER () AS size FROM g), "
    "s AS (SELECT source, CASE WHEN size < 10 OR rank <= round(size * 0.9) THEN 'train' WHEN rank <= round(size * 0.95) THEN 'validation' ELSE 'test' END AS split FROM r) SELECT doc_id, split FROM documents JOIN s USING (source)"
)
def x_grouped_split(spark, d):
    """Split by source, so that no source is on two sides."""
    from tandemtext.operators import sampling

    docs = table(spark, d, "documents").select("doc_id", "source")
    groups = sampling.split(docs.where("source IS NOT NULL").select("source").distinct(), "source", [], train=0.9, validation=0.05)
    return docs.join(groups, "source").select("doc_id", "split")


@R.add("SELECT 'base_clean.csv' AS preferred, 'only.csv' AS single, 'all_scored.csv' AS named, 2 AS ambiguous")
def src04_src05_discovery(spark, d):
    """Which input of a folder is taken: the preferred one, the only one, the one named; several others are an error."""
    regions = table(spark, d, "region").select("r_regionkey")
    one, two, none = _path(spark, "one"), _path(spark, "two"), _path(spark, "none")
    for path in (f"{one}/only.csv", f"{two}/base_clean.csv", f"{two}/x.csv", f"{none}/x.csv", f"{none}/y.csv", f"{none}/all_scored.txt"):
        files.write_csv(regions, path)
    name = lambda path: path.rsplit("/", 1)[1]
    try:
        several = name(files.discover(spark, none))
    except ValueError as e:
        several = int(str(e).split()[0])
    files.write_csv(regions, f"{none}/all_scored.csv")
    return spark.createDataFrame([(name(files.discover(spark, two)), name(files.discover(spark, files.first_existing(spark, [f"{one}/absent", one]))), name(files.discover(spark, none, "all_scored.csv")), several)], "preferred string, single string, named string, ambiguous int")


@R.add("SELECT count(*) AS n, 3 AS attempts FROM region")
def src13_retry(spark, d):
    """A source that fails twice is read at the third attempt."""
    tries = []

    def read():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("not yet")
        return table(spark, d, "region")

    rows = files.read_with_retry(read, lambda: table(spark, d, "region").limit(0), wait=0.0)
    return rows.agg(F.count("*").alias("n")).withColumn("attempts", F.lit(len(tries)))


@R.add("SELECT 'run' AS name, count(*) AS row_count, 0 AS missing FROM nation")
def src16_metadata(spark, d):
    """Facts of a run, written as JSON and read again; where there are none the default holds."""
    path = _path(spark, "metadata")
    missing = files.read_metadata(spark, path, {"rows": 0})["rows"]
    files.write_metadata(spark, path, {"name": "run", "rows": table(spark, d, "nation").count()})
    got = files.read_metadata(spark, path)
    return spark.createDataFrame([(got["name"], got["rows"], missing)], "name string, row_count long, missing int")


@R.add("SELECT doc_id FROM documents WHERE text IS NOT NULL")
def snk02_snk04_periodic_append(spark, d):
    """Results appended batch by batch, each committed as it is done; a second run adds nothing."""
    incoming, out, check = _path(spark, "incoming"), _path(spark, "appended"), _path(spark, "position")
    source = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "loaded_at")
    source.repartition(4).write.parquet(incoming)
    append.append_new(spark, incoming, source.schema, "doc_id", out, check, files_per_batch=1, time="loaded_at", late="3650 days")
    return append.append_new(spark, incoming, source.schema, "doc_id", out, check, time="loaded_at", late="3650 days").select("doc_id")


@R.add("SELECT count(*) AS kept, 1 AS copies, true AS renamed FROM region")
def snk05_snk06_backups(spark, d):
    """A backup under the number of rows is made once; a version before an overwrite has a stamp."""
    path = _path(spark, "backed")
    table(spark, d, "region").write.parquet(path)
    copies = {files.backup_once(spark, path) for _ in range(2)}
    kept = spark.read.parquet(*copies).count()
    version = files.backup(spark, path, "20200101_000000")
    return spark.createDataFrame([(kept, len(copies), version is not None and files.backup(spark, path, "20200101_000000") is None)], "kept long, copies int, renamed boolean")
