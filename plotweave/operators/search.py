"""Search by misspelt and partial names, and by parts of labels, in stored indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from plotweave.functions.paths import display_label
from plotweave.functions.text import norm_text, strip
from plotweave.plans.once import with_once
from plotweave.plans.picking import priority_pick
from plotweave.plans.skew import HOT_ROWS, block_join, marked, saltable, salted_join
from plotweave.session import staging_path

#: Lengths of words that may be misspelt; shorter and longer ones have to be written right.
SHORTEST, LONGEST = 4, 64
#: Greatest length of the parts a label is found by, and folders of an index of labels.
GRAM, PARTS = 8, 64
POSTING = "label_id BIGINT, gram STRING"


def _written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a file below the shared folder, so that no later step computes them again."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _words(text: Column) -> Column:
    """Words of a normal text."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def _deletions(word: Column, edits: int) -> Column:
    """A word and what is left of it after up to ``edits`` deletions, as hashes.

    Two words within that many edits share one of these, whichever of them lost or changed letters.
    """
    forms = F.array(word)
    for _ in range(edits):
        shorter = F.flatten(F.transform(forms, lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w)),
            lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))))
        forms = F.array_distinct(F.concat(forms, shorter))
    return F.transform(forms, lambda form: F.xxhash64(form))


def _forms(word: Column, low: int, high: int, edits: int) -> Column:
    return F.when(F.length(word).between(low, high), _deletions(word, edits)).otherwise(F.array(F.xxhash64(word)))


def _distance(asked: Column, word: Column, edits: int) -> Column:
    """Edits between two words; null where there are too many."""
    loose = F.nullif(F.levenshtein(asked, word, edits), F.lit(-1))
    return F.when(asked == word, 0).when(F.length(asked).between(SHORTEST, LONGEST), loose)


def build_index(gazetteer: DataFrame, path: str, country: str = "us", n: int = 5, edits: int = 1) -> None:
    """Write what ``gazetteer_search`` reads: a country's places by name, names by word, and words by their deletion forms.

    Of the places of one name the first ``n`` by rank and id are kept: no search lists more. Places without name are found by none.
    """
    named = gazetteer.where(F.col("country") == country).withColumn("_name", norm_text(F.col("name"))).where(F.col("_name") != "")
    priority_pick(named, ["_name"], ["place_rank", "place_id"], n).write.mode("overwrite").parquet(f"{path}/places")
    spark = gazetteer.sparkSession
    names = spark.read.parquet(f"{path}/places").groupBy("_name").agg(F.min(F.struct("place_rank", "place_id")).alias("_best"))
    names.select("_name", "_best", F.explode(F.array_distinct(_words(F.col("_name")))).alias("word")).write.mode("overwrite").parquet(f"{path}/names")
    words = spark.read.parquet(f"{path}/names").groupBy("word").agg(F.count("*").alias("_names"))
    forms = _forms(F.col("word"), SHORTEST - edits, LONGEST + edits, edits)
    words.select("word", "_names", F.explode(forms).alias("_form")).write.mode("overwrite").parquet(f"{path}/forms")
    spark.range(1).select(F.lit(n).alias("n"), F.lit(edits).alias("edits")).coalesce(1).write.mode("overwrite").json(f"{path}/settings")


def similar_words(asked: DataFrame, forms: DataFrame, edits: int = 1) -> DataFrame:
    """Indexed words within ``edits`` of the words asked (distinct ``asked``), with the number of names that hold them.

    Both sides meet in hashes of their deletion forms, and the distance is computed for what meets; no word meets all others.
    """
    left = asked.select("asked", F.explode(_forms(F.col("asked"), SHORTEST, LONGEST, edits)).alias("_form"))
    near = _distance(F.col("asked"), F.col("word"), edits).isNotNull()
    return left.join(forms, "_form").where(near).select("asked", "word", "_names").distinct()


def gazetteer_search(queries: DataFrame, index: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Best places per query (``query_id, query``) whose name holds every word of it, each at most the index's edits off.

    Words may be missing from the query and come in any order; words of fewer than four or more than 64 letters have to be exact.
    Best are the fewest edits (``edits``), then the fewest further words in the name (``other_words``), then rank and id of the place. A query
    without any match keeps one row with null place; blank and null queries vanish.

    Equal queries are searched once. Of a query's words the one with the fewest names gives the candidates, and its other words are
    looked up in those names, so a common word costs nothing beside a rarer one. The words to look up and the best
    names are written below the shared folder, so that no later step computes them again.
    """
    spark = queries.sparkSession
    read = lambda name: spark.read.parquet(f"{index}/{name}")
    n, edits = spark.read.schema("n INT, edits INT").json(f"{index}/settings").first()

    texts = queries.select(norm_text(F.col("query")).alias("_text")).where(F.col("_text") != "").distinct()
    parts = _written(texts.select("_text", F.explode(F.array_distinct(_words(F.col("_text")))).alias("asked")), "query-words")
    similar = _written(similar_words(parts.select("asked").distinct(), read("forms"), edits), "similar-words")
    sizes = similar.groupBy("asked").agg(F.sum("_names").alias("_names"))
    # A word that is like none leaves the query without a match.
    rarest = salted_join(parts, sizes, ["asked"], ["_text"], hot_rows, "left").groupBy("_text").agg(
        F.min_by("asked", F.struct("_names", "asked")).alias("asked"), F.bool_and(F.col("_names").isNotNull()).alias("_all")
    ).where("_all").select("_text", "asked")
    reached = _written(salted_join(rarest, similar.select("asked", "word"), ["asked"], ["_text"], hot_rows).select("_text", "word"), "rare-words")
    candidates = salted_join(read("names"), reached, ["word"], ["_name"], hot_rows).select("_text", "_name", "_best").distinct()

    asked, held = _words(F.col("_text")), _words(F.col("_name"))
    distances = F.transform(F.array_distinct(asked), lambda a: F.array_min(F.transform(held, lambda w: _distance(a, w, edits))))
    judged = with_once(candidates, "_distances", distances).withColumn("other_words", F.size(held) - F.size(asked))
    found = judged.where(F.forall("_distances", lambda d: d.isNotNull())).select(
        "_text", "_name", "_best", "other_words", F.aggregate("_distances", F.lit(0), lambda a, d: a + d).alias("edits"))
    best = _written(priority_pick(found, ["_text"], ["edits", "other_words", "_best"], n).drop("_best"), "best-names")
    met = salted_join(best, read("places").drop("country"), ["_name"], ["_text"], hot_rows).drop("_name")
    ranked = priority_pick(met, ["_text"], ["edits", "other_words", "place_rank", "place_id"], n)
    each = queries.withColumn("_text", norm_text(F.col("query"))).where(F.col("_text") != "")
    return salted_join(each, ranked, ["_text"], ["query_id"], hot_rows, "left").drop("_text")


def _part(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def _folder(gram: Column) -> Column:
    """Folder of a substring: that of its first character, so what begins with a short text lies in one."""
    return _part(F.substring(gram, 1, 1))


def _grams(text: Column, whole: bool) -> Column:
    """Different substrings of a text of eight characters; unless ``whole``, also its shorter ends."""
    last = F.length(text) - GRAM + 1 if whole else F.length(text)
    cut = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(GRAM)))
    return F.array_distinct(F.when(last > 0, cut).otherwise(F.array().cast("array<string>")))


def _folders(spark: SparkSession, index: str, name: str, needed: DataFrame | None = None) -> DataFrame:
    """A table of a label index, which lies in one folder per part; only those of the column ``part`` of ``needed`` are read."""
    columns = spark.read.parquet(f"{index}/columns").schema if name == "labels" else StructType.fromDDL(POSTING)
    whole = spark.read.schema(StructType([*columns, StructField("part", IntegerType())])).parquet(f"{index}/{name}")
    return whole if needed is None else whole.where(F.col("part").isin([r.part for r in needed.select("part").distinct().collect()]))


def build_label_index(documents: DataFrame, path: str) -> None:
    """Write the labels of a catalog, what stands at each place of them, up to eight characters, and how many hold each of eight.

    Every substring of at most eight characters begins one of these. The empty one is among them: it leads to all labels, as an
    empty search does.
    """
    label = display_label(F.col("state"), F.col("city"), F.col("name"))
    labels = documents.withColumns({"label": label, "row_hash": F.xxhash64(*saltable(documents))}).withColumn("label_id", F.xxhash64("label"))
    labels.withColumn("part", _part(F.col("label_id"))).hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/labels")
    labels.limit(0).write.mode("overwrite").parquet(f"{path}/columns")  # folders of an empty catalog tell no columns
    low = _folders(documents.sparkSession, path, "labels").select("label_id", F.lower("label").alias("_low")).distinct()
    grams = F.concat(F.array(F.lit("")), _grams(F.col("_low"), whole=False))
    held = low.select("label_id", F.explode(grams).alias("gram")).withColumn("part", _folder(F.col("gram")))
    held.hint("rebalance", "part").sortWithinPartitions("part", "gram").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    longest = _folders(documents.sparkSession, path, "postings").where(F.length("gram") == GRAM)
    longest.groupBy("gram").agg(F.count("*").alias("n_labels")).write.mode("overwrite").parquet(f"{path}/counts")


def label_candidates(texts: DataFrame, index: str) -> DataFrame:
    """Labels (``_text, label_id, part``) that may hold a text (distinct lower-case ``_text``); of texts of up to eight characters all do.

    Such a text begins a substring of the index. Of a longer one the substring of eight characters with the fewest labels gives the
    candidates. With shorter substrings they would grow with texts times labels: there are only some thousand of three
    characters, each in a share of all labels. Only folders of what is looked up are read, and of what they hold only beginnings as long
    as something looked up; a bitmap drops most of these before they are shuffled.
    """
    spark = texts.sparkSession
    text, gram = F.col("_text"), F.col("gram")
    short = texts.where(F.length(text) <= GRAM).select("_text", text.alias("gram"))
    parts = texts.where(F.length(text) > GRAM).select("_text", F.explode(_grams(text, whole=True)).alias("gram"))
    # A substring that no label holds leaves the query without a match.
    rarest = parts.join(spark.read.parquet(f"{index}/counts"), "gram", "left").groupBy("_text").agg(
        F.min_by("gram", F.struct("n_labels", "gram")).alias("gram"), F.bool_and(F.col("n_labels").isNotNull()).alias("_all")
    ).where("_all").select("_text", "gram")
    sought = _written(short.union(rarest), "label-parts")
    sizes = [r[0] for r in sought.select(F.length(gram)).distinct().collect()]
    held = _folders(spark, index, "postings", sought.select(_folder(gram).alias("part"))).withColumn(
        "_size", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")))
    # Every substring begins with the empty one, which stands for itself.
    begun = held.where((F.col("_size") <= F.length(gram)) & ((F.col("_size") > 0) | (gram == ""))).select(
        "label_id", F.substring(gram, F.lit(1), F.col("_size")).alias("gram"))
    met = _written(marked(begun, sought, "gram").distinct(), "label-beginnings")
    return salted_join(met, sought, ["gram"], ["label_id"]).select("_text", "label_id", _part(F.col("label_id")).alias("part"))


def label_search(queries: DataFrame, index: str) -> DataFrame:
    """Catalog rows whose label holds the trimmed query (``query_id, query``), case ignored; as ``catalog_search``, for many queries at once.

    What :func:`label_candidates` finds is compared in full. Equal queries are searched once; labels and queries of a text then
    meet in blocks of bounded size, so that a common text that many ask for is many tasks' work. Null queries find nothing, empty
    ones everything.
    """
    asked = _written(queries.select("query_id", F.lower(strip(F.col("query"))).alias("_text")).where(F.col("_text").isNotNull()), "label-queries")
    reached = _written(label_candidates(asked.select("_text").distinct(), index), "label-candidates")
    found = _folders(queries.sparkSession, index, "labels", reached).join(reached, ["part", "label_id"]).where(
        F.contains(F.lower("label"), F.col("_text"))).drop("part", "label_id")
    return block_join(found, asked, "_text", "row_hash", "query_id").drop("_text", "row_hash")
