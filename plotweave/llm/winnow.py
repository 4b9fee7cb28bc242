"""Repeated runs of lines and of words, found by winnowing their hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import staged, text_of
from plotweave.llm.spans import named
from plotweave.plans.once import with_once
from plotweave.plans.skew import salted_join

#: A run of lines is removed when it repeats an earlier one and has this many words at least.
LEAST_WORDS = 50
#: Words of a fingerprint of a passage.
GRAM = 8
#: Runs meeting in one line, or in one earlier document, that one task takes before they are dealt to several.
HOT_RUNS = 20_000


def _spaced(text: Column, blanks: str) -> Column:
    """The text with spaces for other blanks; plain replacements look at bytes and cost far less than a pattern."""
    for blank in blanks:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return text


def _plain(line: Column) -> Column:
    """A line whose only blanks are spaces, without needless ones."""
    return F.trim(F.when(F.contains(line, F.lit("  ")), F.regexp_replace(line, " {2,}", " ")).otherwise(line))


def _word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(_spaced(text, "\t\n\x0b\x0c\r"), " "), ""), lambda w: F.xxhash64(w))


def _windows(least_words: int) -> Column:
    """Shortest windows of at least ``least_words`` words, one per line that starts one.

    Each is ``struct<i, m, w>``: first line, line of least hash (the last such) and hash of the whole window. As every line has a word, a
    window has at most ``least_words`` lines.
    """
    def window(i: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(2**63 - 1).alias("least"), F.lit(-1).alias("m"), F.lit(0).cast("bigint").alias("w"))

        def step(acc: Column, j: Column) -> Column:
            h = F.get("_h", j)
            better = h <= acc["least"]
            return F.when(acc["n"] >= least_words, acc).otherwise(F.struct(
                (acc["n"] + F.get("_w", j)).alias("n"), F.least(h, acc["least"]).alias("least"),
                F.when(better, j).otherwise(acc["m"]).alias("m"), F.xxhash64(acc["w"], h).alias("w")))

        lines = F.sequence(i, F.least(i + least_words, F.size("_h")) - 1)
        return F.aggregate(lines, start, step, lambda acc: F.struct(
            i.alias("i"), acc["m"].alias("m"), acc["w"].alias("w"), (acc["n"] >= least_words).alias("full")))

    every = F.when(F.size("_h") > 0, F.transform(F.sequence(F.lit(0), F.size("_h") - 1), window)).otherwise(
        F.array().cast("array<struct<i:int,m:int,w:bigint,full:boolean>>"))
    return F.transform(F.filter(every, lambda x: x["full"]), lambda x: F.struct(x["i"].alias("i"), x["m"].alias("m"), x["w"].alias("w")))


def _runs(least_words: int) -> Column:
    """Maximal runs of equal lines on a diagonal that hold a matched window start and enough words."""
    low = F.greatest(F.lit(0), F.col("_d"))
    high = F.least(F.size("_h"), F.size("_h0") + F.col("_d")) - 1
    breaks = F.filter(F.sequence(low, high), lambda i: F.get("_h", i) != F.get("_h0", i - F.col("_d")))
    borders = F.concat(F.array(low - 1), breaks, F.array(high + 1))
    between = lambda b: F.transform(F.slice(b, 2, F.size(b) - 1), lambda x, j: F.struct(
        (F.get(b, j) + 1).alias("a"), (x - 1).alias("b")))
    words = lambda r: F.get("_c", r["b"] + 1) - F.get("_c", r["a"])
    return F.filter(named(borders, between), lambda r: (r["a"] <= r["b"]) & (words(r) >= least_words)
                    & F.exists("_at", lambda p: p.between(r["a"], r["b"])))


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """Lines to remove: ``doc_id, text_hash, n_lines, lines, n_words`` for every different (id, text).

    ``n_lines`` counts lines with a word. ``lines`` are the numbers, from 0 over all lines, of those in runs of ``least_words`` and more words that
    repeat an earlier run, in the order of (id, hash of the text, line); ``n_words`` are their words. Spaces within lines
    do not count, case does.

    1. Windows of lines with ``least_words`` words are winnowed: the line of least hash in each is a fingerprint, and equal runs
       that hold a window share one.
    2. Fingerprints found more than once are joined back; windows around them are looked up by their hash, which
       gives positions of an earlier equal window: the one before in the same document, else the first of all.
    3. From each matched position the run is extended both ways along line hashes of the two documents.

    What is compared are hashes of lines and windows, 64 bits wide. Every removed line has an equal line that stays, the first of them.

    Null and blank texts have no lines. A null id sorts first. Rows equal in id and text are one document: none
    of them is emptied for the other's sake. An empty table gives no rows. Other columns are ignored.
    """
    lined = with_once(
        docs.select(F.col(doc_id).alias("doc_id"), text_of(F.col(text)).alias("_text")).withColumn("text_hash", F.xxhash64("_text")),
        "_lines", F.filter(
            F.transform(F.split(_spaced(F.col("_text"), "\t\x0b\x0c\r"), "\n"), lambda x, p: F.struct(p.alias("p"), _plain(x).alias("x"))), lambda x: x["x"] != ""))
    spaces = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))
    hashed = lined.select(
        "doc_id", "text_hash", F.transform("_lines", lambda x: x["p"]).alias("_p"),
        F.transform("_lines", lambda x: F.xxhash64(x["x"])).alias("_h"), F.transform("_lines", lambda x: spaces(x["x"]) + 1).alias("_w"))
    rows = staged(hashed, "lines").dropDuplicates(["doc_id", "text_hash"])
    sums = F.aggregate("_w", F.array(F.lit(0)), lambda c, w: F.array_append(c, F.element_at(c, -1) + w))
    base = staged(with_once(rows, "_win", _windows(least_words)).withColumn("_c", sums), "windows")

    prints = base.select("doc_id", "text_hash", F.explode(F.array_distinct(F.transform("_win", lambda x: x["m"]))).alias("m"), "_h").select(
        "doc_id", "text_hash", "m", F.get("_h", F.col("m")).alias("h"))
    often = prints.groupBy("h").agg(F.count("*").alias("_n")).where("_n > 1").select("h")
    suspects = salted_join(prints, often, ["h"], ["doc_id", "text_hash", "m"], HOT_RUNS).groupBy(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th")).agg(F.collect_set("m").alias("_m"))
    same = base["doc_id"].eqNullSafe(suspects["_id"]) & (base["text_hash"] == suspects["_th"])
    ordered = F.sort_array(F.transform(
        F.filter("_win", lambda x: F.array_contains("_m", x["m"])), lambda x: F.struct(x["w"].alias("w"), x["i"].alias("i"))))
    before = lambda s: F.transform(s, lambda x, j: F.struct(
        x["w"].alias("w"), x["i"].alias("i"), F.when(F.get(s, j - 1)["w"] == x["w"], F.get(s, j - 1)["i"]).alias("prior")))
    looked = staged(base.join(suspects, same).select("doc_id", "text_hash", F.explode(named(ordered, before)).alias("x")).select(
        "doc_id", "text_hash", "x.*"), "looked")

    within = looked.where("prior is not null").select(
        "doc_id", "text_hash", F.col("doc_id").alias("_id0"), F.col("text_hash").alias("_th0"), "i", (F.col("i") - F.col("prior")).alias("_d"))
    heads = looked.where("prior is null")
    origin = heads.groupBy("w").agg(F.min(F.struct("doc_id", "text_hash", "i")).alias("_o"), F.count("*").alias("_n")).where("_n > 1").select("w", "_o")
    across = salted_join(heads, origin, ["w"], ["doc_id", "text_hash", "i"], HOT_RUNS).where(
        ~(F.col("doc_id").eqNullSafe(F.col("_o.doc_id")) & (F.col("text_hash") == F.col("_o.text_hash")))
    ).select("doc_id", "text_hash", F.col("_o.doc_id").alias("_id0"), F.col("_o.text_hash").alias("_th0"), "i", (F.col("i") - F.col("_o.i")).alias("_d"))
    diagonals = within.union(across).groupBy("doc_id", "text_hash", "_id0", "_th0", "_d").agg(F.collect_set("i").alias("_at"))

    own = base.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th"), "_h", "_c")
    left = diagonals.join(own, diagonals["doc_id"].eqNullSafe(own["_id"]) & (diagonals["text_hash"] == own["_th"])).drop("_id", "_th")
    left = staged(left.withColumns({"_no0": F.col("_id0").isNull(), "_id0": F.coalesce("_id0", F.lit(0))}), "diagonals")
    earlier = base.select(F.col("doc_id").isNull().alias("_no0"), F.coalesce("doc_id", F.lit(0)).alias("_id0"),
                          F.col("text_hash").alias("_th0"), F.col("_h").alias("_h0"))
    matched = salted_join(left, earlier, ["_no0", "_id0", "_th0"], ["doc_id", "text_hash", "_d"], HOT_RUNS)
    gone = (
        matched.select("doc_id", "text_hash", F.explode(_runs(least_words)).alias("r"))
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th"))
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("r.a", "r.b"))))).alias("_gone"))
    )
    found = base.join(gone, base["doc_id"].eqNullSafe(gone["_id"]) & (base["text_hash"] == gone["_th"]), "left")
    lost = F.coalesce("_gone", F.array().cast("array<int>"))
    return found.select(
        "doc_id", "text_hash", F.size("_h").cast("bigint").alias("n_lines"),
        F.transform(lost, lambda i: F.get("_p", i)).alias("lines"),
        F.aggregate(F.transform(lost, lambda i: F.get("_w", i)), F.lit(0), lambda t, w: t + w).cast("bigint").alias("n_words"))


def _least_in_windows(values: Column, width: int) -> Column:
    """Least of every ``width`` values in a row, by doubling; windows that reach over the end hold what is there."""
    shifts = [1 << k for k in range(width.bit_length() - 1)]
    shifts.append(width - (1 << len(shifts)))
    return F.aggregate(F.array(*[F.lit(s) for s in shifts if s]), values, lambda m, s: F.zip_with(
        m, F.slice(m, s + 1, F.size(m)), lambda a, b: F.least(a, b)))


def _stretches(hashes: Column, least_words: int) -> Column:
    """``struct<lo, hi, f, s>``: windows ``lo`` to ``hi`` of ``least_words`` words that share a fingerprint, its hash, and the hash of all their words.

    The fingerprint of a window is its first ``gram`` words whose beginning has the least hash; beginnings of three words differ more
    than words do. Values hold the upper half of the hash and the place in the lower, so that the least of a window also says where it is.
    """
    gram = min(GRAM, least_words)
    width = least_words - gram + 1
    place = lambda x: x.bitwiseAND(F.lit(2**32 - 1)).cast("int")

    def of(h: Column) -> Column:
        last = F.size(h) - least_words
        values = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, min(3, gram))]).bitwiseAND(F.lit(-(2**32))) + i)
        tops = F.array_distinct(F.slice(_least_in_windows(values, width), 1, last + 1))
        lows = lambda t: F.transform(t, lambda x, j: F.struct(place(x).alias("p"), F.when(j == 0, 0).when(
            x < F.get(t, j - 1), place(x) - width + 1).otherwise(place(F.get(t, j - 1)) + 1).alias("lo")))
        spans = lambda r: F.transform(r, lambda x, j: F.struct(
            x["p"].alias("p"), x["lo"].alias("lo"), F.coalesce(F.get(r, j + 1)["lo"] - 1, last).alias("hi")))
        hashed = lambda r: F.transform(r, lambda x: F.struct(
            x["lo"].alias("lo"), x["hi"].alias("hi"), F.xxhash64(F.slice(h, x["p"] + 1, gram)).alias("f"),
            F.xxhash64(F.slice(h, x["lo"] + 1, x["hi"] - x["lo"] + least_words)).alias("s")))
        return hashed(named(named(tops, lows), spans))

    return named(hashes, lambda h: F.when(F.size(h) >= least_words, of(h)))


def _repeated(rows: DataFrame, keys: list[str], salt_by: list[str]) -> DataFrame:
    """The rows whose key occurs more than once."""
    counts = staged(rows.groupBy(*keys).agg(F.count("*").alias("_rows")).where("_rows > 1"), "counts")
    return salted_join(rows, counts.drop("_rows"), keys, salt_by, HOT_RUNS, counts=counts)


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """Words to remove, wherever in a line they start and end: ``doc_id, text_hash, passages, n_words`` for each (id, text) with any.

    ``passages`` are ``struct<a, b>``, first and last word from 0 over the whole text: the words of all runs of ``least_words`` and more words
    that occur earlier, in the order of (id, hash of the text, word). Line ends and spaces only separate words; case counts.

    1. Every window of ``least_words`` words has a fingerprint within; windows in a row that share one make a stretch. Equal windows
       have equal fingerprints, so a repeated run shares all of them with the earlier one.
    2. A stretch equal to an earlier one goes whole.
    3. Of different stretches with one fingerprint the first of each kind is laid out window by window, and windows with an earlier
       equal go. The first of equal windows lies in the first stretch of its kind, so nothing else has to be laid out.

    The union of repeated windows is the union of the longest repeated runs. Compared are 64-bit hashes of words, taken together.
    """
    whole = docs.select(F.col(doc_id).alias("doc_id"), text_of(F.col(text)).alias("_text")).withColumn("text_hash", F.xxhash64("_text"))
    hashes = _word_hashes(F.col("_text"))
    prints = staged(whole.select("doc_id", "text_hash", F.explode(_stretches(hashes, least_words)).alias("x")).select("doc_id", "text_hash", "x.*"), "prints")

    # Rows that repeat id and text give the same occurrence twice: what is counted twice for that alone is its own first occurrence and goes nowhere.
    suspects = staged(_repeated(prints, ["f"], ["doc_id", "text_hash", "lo"]), "suspects")
    kinds = staged(suspects.groupBy("f", "s").agg(F.min(F.struct("doc_id", "text_hash", "lo", "hi")).alias("_o"), F.count("*").alias("_rows")), "kinds")
    other = ~F.struct("doc_id", "text_hash", "lo", "hi").eqNullSafe(F.col("_o"))
    again = kinds.where("_rows > 1")
    stretches = salted_join(suspects, again.drop("_rows"), ["f", "s"], ["doc_id", "text_hash", "lo"], HOT_RUNS, counts=again).where(other).select(
        "doc_id", "text_hash", F.col("lo").alias("a"), (F.col("hi") + least_words - 1).alias("b"))

    laid = _repeated(kinds.drop("_rows"), ["f"], ["s"]).groupBy(
        F.col("_o.doc_id").alias("_id"), F.col("_o.text_hash").alias("_th")).agg(F.collect_set(F.struct("_o.lo", "_o.hi")).alias("_at"))
    own = whole.join(laid.hint("merge"), whole["doc_id"].eqNullSafe(laid["_id"]) & (whole["text_hash"] == laid["_th"]))
    window = lambda h: lambda i: F.struct(i.alias("i"), F.xxhash64(F.slice(h, i + 1, least_words)).alias("w"))
    windows = staged(
        own.select("doc_id", "text_hash", F.explode(named(hashes, lambda h: F.flatten(
            F.transform("_at", lambda x: F.transform(F.sequence(x["lo"], x["hi"]), window(h)))))).alias("x"))
        .select("doc_id", "text_hash", "x.*"), "looked")
    at = F.struct("doc_id", "text_hash", "i")
    twice = staged(_repeated(windows, ["w"], ["doc_id", "text_hash", "i"]), "twice")
    origin = staged(twice.groupBy("w").agg(F.min(at).alias("_o"), F.count("*").alias("_rows")), "origins")
    single = salted_join(twice, origin.drop("_rows"), ["w"], ["doc_id", "text_hash", "i"], HOT_RUNS, counts=origin).where(~at.eqNullSafe(F.col("_o"))).select(
        "doc_id", "text_hash", F.col("i").alias("a"), (F.col("i") + least_words - 1).alias("b"))

    # Sorted by their starts, ranges of one text are sorted by their ends as well.
    gap = lambda x, y: y.isNull() | (y["a"] > x["b"] + 1)
    merged = lambda r: F.zip_with(
        F.filter(r, lambda y, j: (j == 0) | gap(F.get(r, j - 1), y)), F.filter(r, lambda x, j: gap(x, F.get(r, j + 1))),
        lambda x, y: F.struct(x["a"].alias("a"), y["b"].alias("b")))
    ranges = stretches.union(single).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("_r"))
    return with_once(ranges, "passages", named(F.col("_r"), merged)).select(
        "doc_id", "text_hash", "passages",
        F.aggregate("passages", F.lit(0).cast("bigint"), lambda n, x: n + x["b"] - x["a"] + 1).alias("n_words"))


def _without(text: Column, passages: Column) -> Column:
    """The text without ranges of its words. Lines left without a word go with their line end; other lines stay apart."""
    blank = r"[\x20\x09-\x0D]"
    unled = lambda x: F.regexp_replace(x, f"^{blank}+", "")
    led = lambda x: F.regexp_extract(x, f"^{blank}*", 0)
    tail = F.regexp_extract(text, f"(?<!{blank}){blank}*+$", 0)

    def cut(tokens: Column) -> Column:
        n = F.size(tokens)

        def piece(r: Column, j: Column) -> Column:
            start = F.when(j == 0, 0).otherwise(F.get(passages, j - 1)["b"] + 1)
            kept = F.array_join(F.slice(tokens, start + 1, r["a"] - start), "")
            last = r["b"] == n - 1
            ahead, behind = led(F.get(tokens, r["a"])), F.when(last, tail).otherwise(led(F.get(tokens, r["b"] + 1)))
            to_line = F.regexp_extract(ahead, r"(?s)^.*\n", 0)
            between = (
                F.when((r["a"] > 0) & ~F.contains(ahead, F.lit("\n")), behind)
                .when(F.contains(behind, F.lit("\n")), F.concat(to_line, F.regexp_replace(behind, r"^[^\n]*\n", "")))
                .when(last, F.regexp_extract(ahead, r"(?s)^(.*)\n", 1)).otherwise(to_line))
            return F.concat(F.when(j == 0, kept).otherwise(unled(kept)), between)

        end = F.element_at(passages, -1)["b"]
        rest = F.when(end < n - 1, F.concat(unled(F.array_join(F.slice(tokens, end + 2, n), "")), tail)).otherwise("")
        return F.concat(F.array_join(F.transform(passages, piece), ""), rest)

    return named(F.regexp_extract_all(text, F.lit(f"{blank}*+[^\\x20\\x09-\\x0D]++"), F.lit(0)), cut)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """All rows and columns, the text without :func:`repeated_passages`, which hold all lines of :func:`repeated_lines`; null texts stay null.

    How many documents lose words grows with the corpus, so they meet their texts in a merge join at every size.
    """
    removed = repeated_passages(docs, doc_id, text, least_words).select(
        F.col("doc_id").alias("_wn_id"), F.col("text_hash").alias("_wn_hash"), F.col("passages").alias("_wn_passages"))
    keyed = docs.withColumn("_wn_key", F.xxhash64(text_of(F.col(text))))
    joined = keyed.join(removed.hint("merge"), F.col(doc_id).eqNullSafe(F.col("_wn_id")) & (F.col("_wn_key") == F.col("_wn_hash")), "left")
    left = _without(F.col(text), F.col("_wn_passages"))
    return joined.withColumn(text, F.when(F.col("_wn_passages").isNotNull(), left).otherwise(F.col(text))).select(*docs.columns)
