"""Benchmark passages in documents, also with other numbers, names and units.

Text becomes a row of words in which numbers, names and units are typed
placeholders; punctuation and case are dropped. Windows of eight such words
are hashed and joined with the benchmark's windows by the hash alone, which are
sent to every task while they are few; the documents with equal hashes are read
again and checked word by word. An item is found in a document if half of its windows are, or
six of them, and if the slots agree: within one place of the document, a value
of the benchmark may stand for one value only. So a question with its numbers
changed throughout is caught, and a chance likeness of tables of numbers is not.

Everything runs as column expressions. There are two forms of each text. In the
first, names are words with a capital after a small letter, digit, comma or
semicolon; in the second, all words with a capital, so those that start a
sentence too. A form is matched with itself, and either is enough. Characters of
scripts without spaces are words of their own. Items of less than eight words
are one window of their own length; windows with less than four plain words are
no evidence. Items without a window in the second form are looked for whole,
word by word with their values, if they have eight letters or digits, or four of
scripts without spaces: shorter ones cannot be told from common words.

Null texts have no words; null document ids are kept apart by their text, null
item ids name one item. Repeated rows of a document give one result, repeated
items count as one. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemodels.llm.common import saved

WINDOW = 8
PLAIN = 4
ENOUGH = 6
AGREE = 0.8
SMALL_BENCHMARK = 500_000  # windows that may be sent to every task
# ASCII marks, Latin-1 signs, general and CJK punctuation.
PUNCTUATION = r"\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u2010-\u2027\u2030-\u205e\u3001-\u3003\u3008-\u3011"
NAME, NUMBER, UNIT = "\u0001", "\u0002", "\u0003"
CAPITAL = "\u0004"  # a name in the second form only
FORMS = (1, 2)
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}"
BEYOND = r"[\x{e00}-\x{10ffff}]"  # holds all of these scripts
LETTERS, UNSPACED_LETTERS = 8, 4
UNITS = (
    "kg|g|mg|t|km|m|cm|mm|mi|miles?|feet|ft|inch(?:es)?|l|ml|liters?|litres?|h|hours?|min|minutes?|s|seconds?|days?|weeks?|"
    "months?|years?|percent|dollars?|euros?|cents?|pounds?|degrees?|mph|kmh|w|kw|v|hz|mb|gb"
)


def marked(text: Column) -> Column:
    """The text in lower case without punctuation, with a mark in front of every name, number and unit.

    Patterns start with a plain character where they can, and the rarer ones
    run only over texts with a digit: this is most of the operator's time.
    """
    x = F.coalesce(text.cast("string"), F.lit(""))
    x = F.regexp_replace(x, r"[\x00-\x1f]", " ")
    unspaced = x.rlike(BEYOND) & x.rlike(f"[{UNSPACED}]")  # a range is looked for much faster than scripts are
    x = F.when(unspaced, F.regexp_replace(x, rf"([{UNSPACED}]\p{{M}}*)", " $1 ")).otherwise(x)
    x = F.regexp_replace(x, r" (?<=[\p{Ll}\p{N},;] )(?=\p{Lu})", " " + NAME)
    x = F.regexp_replace(F.concat(F.lit(" "), x), rf" (?=[{PUNCTUATION}]*\p{{Lu}})", " " + CAPITAL)
    numbers = F.regexp_replace(x, r"(?<![\p{L}\p{N}.,:/\x01])(?=\p{Sc}?[0-9])", NUMBER)
    numbers = F.regexp_replace(numbers, rf" (?=(?:{UNITS}|%)(?![\p{{L}}\p{{N}}]))(?<=\x02[^\s\x02]{{1,30}} )", " " + UNIT)
    x = F.when(x.rlike("[0-9]"), numbers).otherwise(x)
    return F.lower(F.regexp_replace(x, f"[{PUNCTUATION}]", ""))


def in_form(marked_text: Column, form: int) -> Column:
    return F.translate(marked_text, CAPITAL, "" if form == 1 else NAME)


def bare_words(marked_text: Column) -> Column:
    """Words with the values of slots, without marks."""
    return words_of(F.translate(marked_text, NAME + NUMBER + UNIT + CAPITAL, ""))


def words_of(marked_text: Column) -> Column:
    """Words, slots with their values."""
    return F.array_remove(F.split(marked_text, " "), "")


def template_of(marked_text: Column) -> Column:
    """The same words with only the mark of each slot."""
    bare = F.regexp_replace(marked_text, r"([\x01-\x03])[^ ]*", "$1")
    return words_of(F.when(marked_text.rlike(r"[\x01-\x03]"), bare).otherwise(marked_text))


def _paired(frame: DataFrame, names: list[str]) -> DataFrame:
    """Columns of word hashes as hashes of the windows of eight words, in three doublings.

    Each doubling is a projection of its own, as its input is read twice.
    """
    for step in (1, 2, 4):
        def doubled(c, step=step):
            return F.zip_with(c, F.slice(c, F.lit(step + 1), F.greatest(F.size(c), F.lit(0))), lambda x, y: F.xxhash64(x, y))

        frame = frame.withColumns({n: doubled(F.col(n)) for n in names})
    return frame


def _window_hash(words: Column, size: int) -> Column:
    """Hash of a window given as the array of its word hashes, as ``_windows_of`` finds it."""
    if size != WINDOW:
        return F.xxhash64(words)
    hashes = [F.get(words, F.lit(i)) for i in range(size)]
    while len(hashes) > 1:
        hashes = [F.xxhash64(x, y) for x, y in zip(hashes[::2], hashes[1::2])]
    return hashes[0]


def _windows_of(hashes: Column, n: Column, size: int) -> Column:
    """Hashes of the first ``n`` windows of so many words.

    ``hashes`` holds the hashes of the windows of eight words, or of the words for windows of other sizes.
    """
    firsts = F.slice(hashes, F.lit(1), n)
    if size == WINDOW:
        return firsts
    return F.transform(firsts, lambda _, i: F.xxhash64(F.slice(hashes, i + 1, F.lit(size))))


def _met(hashed: DataFrame, sent: DataFrame, kinds: list[tuple[Column, str, str, int]]) -> DataFrame:
    """(d, h, number, d_at) of the documents' windows with the hash of a benchmark window of their kind.

    A kind is a condition on benchmark windows, the columns of a document's hashes and number of words, and a size. The
    plan holds nothing of the benchmark's: it would be written out with every text of the plan on the driver.
    """
    n = [F.greatest(F.col(words) - size + 1, F.lit(0)) for _, _, words, size in kinds]
    lists = [_windows_of(F.col(hashes), n[k], size) for k, (_, hashes, _, size) in enumerate(kinds)]
    before = [sum(n[:k], F.lit(0)) for k in range(len(kinds))]
    # The lists are made in a projection of their own, so that unfolding and join are compiled as one.
    each = hashed.select(
        "d", "h", F.concat(*lists).alias("lists"), F.array(*n).alias("n"), F.array(*before).alias("before")
    )
    # The outer form: for the plain one the windows are worked out a second time, to drop empty arrays first.
    each = each.select("d", "h", "n", "before", F.posexplode_outer("lists").alias("i", "d_hash"))
    kind = F.coalesce(*[F.when(of, F.lit(k)) for k, (of, _, _, _) in enumerate(kinds)])
    at = F.col("i") - F.get("before", kind)
    met = each.join(sent, (F.col("d_hash") == F.col("hash")) & (at >= 0) & (at < F.get("n", kind)))
    return met.select("d", "h", "number", (at + 1).alias("d_at"))


def _numbered(windows: DataFrame, label: str) -> DataFrame:
    """The table written with a number for every row."""
    return saved(windows.withColumn("number", F.monotonically_increasing_id()), label)


def _sent(windows: DataFrame, *keys: str) -> DataFrame:
    """Numbers and keys of benchmark windows, a few dozen bytes each, sent to every task while they are few."""
    small = windows.select("number", *keys)
    return F.broadcast(small) if windows.limit(SMALL_BENCHMARK + 1).count() <= SMALL_BENCHMARK else small


def _keyed(docs: DataFrame) -> DataFrame:
    """(d, h, text): what tells documents apart, an id and 128 bits of the text, and the text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("d"), F.md5(text.cast("binary")).alias("h"), text.alias("text"))


def _texts_of(keyed: DataFrame, met: DataFrame) -> DataFrame:
    """(wd, wh, m) of the documents in ``met``: only their texts are marked again."""
    matched = saved(met.select(F.col("d").alias("md"), F.col("h").alias("mh")).distinct(), "matched-documents")
    same = F.col("d").eqNullSafe(F.col("md")) & (F.col("h") == F.col("mh"))
    texts = keyed.join(matched, same, "left_semi").dropDuplicates(["d", "h"])
    return texts.select(F.col("d").alias("wd"), F.col("h").alias("wh"), marked(F.col("text")).alias("m"))


def _word_hashes(template: Column) -> Column:
    return F.transform(template, lambda w: F.xxhash64(w))


def _slots(template: Column) -> Column:
    return F.filter(template, lambda w: w.isin(NAME, NUMBER, UNIT))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(form, item, size, at, hash, i_template, i_words, item_windows) of every window that is evidence."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item"), marked(F.col("text")).alias("m"))
    forms = F.array(*[F.struct(F.lit(f).alias("form"), in_form(F.col("m"), f).alias("m"),
                                (in_form(F.col("m"), 1) if f == 1 else F.col("m")).alias("r")) for f in FORMS])
    rows = rows.select("item", F.explode(forms).alias("f")).select("item", "f.*")
    rows = rows.select("form", "item", words_of(F.col("r")).alias("w"), template_of(F.col("m")).alias("t")).distinct()
    rows = rows.filter(F.size("t") >= PLAIN).withColumn("size", F.least(F.size("t"), F.lit(WINDOW)))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.size("t") - F.col("size") + 1)).alias("at"))
    cut = rows.select(
        "form", "item", "size", "at", F.slice("t", F.col("at"), F.col("size")).alias("i_template"),
        F.slice("w", F.col("at"), F.col("size")).alias("i_words"),
    )
    cut = cut.filter(F.size("i_template") - F.size(_slots(F.col("i_template"))) >= PLAIN)
    whole = F.col("size") == WINDOW
    hashes = _word_hashes(F.col("i_template"))
    cut = cut.withColumn("hash", F.when(whole, _window_hash(hashes, WINDOW)).otherwise(F.xxhash64(hashes)))
    cut = cut.dropDuplicates(["form", "item", "size", "at", "hash"])
    n = cut.groupBy("form", "item").agg(F.count("*").alias("item_windows"))
    return cut.join(n, cut.item.eqNullSafe(n.item) & (cut.form == n.form)).drop(n.item).drop(n.form)


def whole_items(benchmark: DataFrame, windows: DataFrame) -> DataFrame:
    """(item, i_whole, size, hash) of the items to be looked for whole, with the hash of their first words."""
    known = windows.filter(F.col("form") == 2).select(F.col("item").alias("known")).distinct()
    rows = benchmark.select(F.col("item_id").cast("long").alias("item"), marked(F.col("text")).alias("m"))
    rows = rows.join(known, F.col("item").eqNullSafe(F.col("known")), "left_anti")
    rows = rows.select("item", bare_words(F.col("m")).alias("i_whole")).distinct()
    text = F.array_join("i_whole", "")
    enough = (F.length(text) >= LETTERS) | (F.length(F.regexp_replace(text, f"[^{UNSPACED}]", "")) >= UNSPACED_LETTERS)
    rows = rows.filter(enough).withColumn("size", F.least(F.size("i_whole"), F.lit(WINDOW)))
    hashes = _word_hashes(F.slice("i_whole", F.lit(1), F.col("size")))
    whole = F.col("size") == WINDOW
    return rows.withColumn("hash", F.when(whole, _window_hash(hashes, WINDOW)).otherwise(F.xxhash64(hashes)))


def _whole_leaks(keyed: DataFrame, items: DataFrame) -> DataFrame | None:
    """The rows of ``leaks`` for items that stand in a document word by word, None if there are no such items."""
    items = _numbered(items, "whole-items")
    sizes = [r["size"] for r in items.select("size").distinct().orderBy("size").collect()]  # at most eight
    if not sizes:
        return None
    hashed = keyed.select("d", "h", _word_hashes(bare_words(marked(F.col("text")))).alias("wh"))
    hashed = _paired(hashed.withColumns({"w8": F.col("wh"), "words": F.size("wh")}), ["w8"])
    kinds = [(F.col("size") == s, "w8" if s == WINDOW else "wh", "words", s) for s in sizes]
    met = saved(_met(hashed, _sent(items, "hash", "size"), kinds), "whole-matches")
    met = met.join(items.select("number", "item", "i_whole"), "number")
    words = _texts_of(keyed, met).select("wd", "wh", bare_words(F.col("m")).alias("w"))
    met = met.join(words, F.col("d").eqNullSafe(F.col("wd")) & (F.col("h") == F.col("wh")))
    met = met.filter(F.slice("w", F.col("d_at"), F.size("i_whole")) == F.col("i_whole"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    return met.select("d", "h", "item").distinct().select(
        F.col("d").alias("doc_id"), F.col("item").alias("item_id"), one.alias("matched_windows"), one.alias("item_windows"),
        zero.alias("slots"), zero.alias("changed_slots"), F.lit(1.0).alias("agreement"), F.col("h").alias("_text_hash"),
    )


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contaminated (doc_id, item_id) pairs with their evidence, and ``_text_hash`` of the document."""
    windows = _numbered(benchmark_windows(benchmark), "benchmark-windows")
    whole = whole_items(benchmark, windows)
    kinds = [tuple(r) for r in windows.select("form", "size").distinct().orderBy("form", "size").collect()]  # few
    keyed = _keyed(docs)
    kinds = kinds or [(1, WINDOW)]
    hashed = keyed.select("d", "h", marked(F.col("text")).alias("m"))
    hashed = hashed.select("d", "h", *[in_form(F.col("m"), f).alias(f"m{f}") for f in FORMS])
    hashed = hashed.select("d", "h", *[_word_hashes(template_of(F.col(f"m{f}"))).alias(f"wh{f}") for f in FORMS])
    hashed = hashed.select("*", *[F.col(f"wh{f}").alias(f"w8_{f}") for f in FORMS], *[F.size(f"wh{f}").alias(f"words{f}") for f in FORMS])
    hashed = _paired(hashed, [f"w8_{f}" for f in FORMS])
    kinds = [
        ((F.col("form") == f) & (F.col("size") == s), f"w8_{f}" if s == WINDOW else f"wh{f}", f"words{f}", s) for f, s in kinds
    ]
    met = saved(_met(hashed, _sent(windows, "hash", "size", "form"), kinds), "window-matches")
    met = met.join(windows.drop("hash"), "number")
    # Only the documents with a match are read again, for the words themselves.
    words = _texts_of(keyed, met).select("wd", "wh", words_of(F.col("m")).alias("w"))
    met = met.join(words, F.col("d").eqNullSafe(F.col("wd")) & (F.col("h") == F.col("wh"))).select(
        "d", "h", "form", "item", "at", "item_windows", "i_template", "i_words", (F.col("d_at") - F.col("at")).alias("place"),
        F.array_join(F.slice("w", F.col("d_at"), F.col("size")), " ").alias("cut"),
    )
    first = F.col("form") == 1
    met = met.withColumns({
        "d_words": words_of(F.when(first, in_form(F.col("cut"), 1)).otherwise(F.col("cut"))),
        "d_template": template_of(F.when(first, in_form(F.col("cut"), 1)).otherwise(in_form(F.col("cut"), 2))),
    })
    met = met.filter(F.col("d_template") == F.col("i_template"))
    def named(word):
        return F.translate(word, CAPITAL, NAME)

    trio = F.transform(
        F.arrays_zip(F.col("i_template").alias("t"), F.col("i_words").alias("i"), F.col("d_words").alias("d")),
        lambda x: F.when(
            # The same word with a capital, as at the start of a sentence, tells nothing about values.
            x["t"].isin(NAME, NUMBER, UNIT) & ~(x["i"].startswith(CAPITAL) & (named(x["i"]) == named(x["d"]))),
            F.struct(F.col("place").alias("place"), named(x["i"]).alias("i"), named(x["d"]).alias("d")),
        ),
    )
    met = met.withColumn("slots", F.filter(trio, lambda s: s.isNotNull()))
    found = met.groupBy("d", "h", "form", "item").agg(
        F.size(F.collect_set("at")).alias("matched_windows"),
        F.max("item_windows").alias("item_windows"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
    )
    values = F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["place"], s["i"]))))
    found = found.select(
        F.col("d").alias("doc_id"), F.col("item").alias("item_id"),
        F.col("matched_windows").cast("long"), F.col("item_windows").cast("long"),
        F.size("slots").cast("long").alias("slots"),
        F.size(F.filter("slots", lambda s: s["i"] != s["d"])).cast("long").alias("changed_slots"),
        F.when(F.size("slots") > 0, values / F.size("slots")).otherwise(F.lit(1.0)).alias("agreement"),
        F.col("h").alias("_text_hash"),
    )
    key = ("doc_id", "item_id", "_text_hash")
    enough = F.least(F.lit(ENOUGH), F.ceil(F.col("item_windows") / 2))
    found = found.filter((F.col("matched_windows") >= enough) & (F.col("agreement") >= AGREE))
    exact = _whole_leaks(keyed, whole)
    if exact is not None:
        found = found.union(exact)
    # One row for each pair: the form with more of the item.
    most = F.struct(F.col("matched_windows") / F.col("item_windows"), *[c for c in found.columns if c not in key])
    best = found.groupBy(*key).agg(F.max(most).alias("x"))
    return best.select(*[c if c in key else F.col(f"x.{c}").alias(c) for c in found.columns])


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").cast("long").alias("_bad_id"), F.col("_text_hash").alias("_bad_hash"))
    bad = saved(bad.distinct(), "leaking-documents")
    text = F.col("text").cast("string").cast("binary")
    keyed = docs.withColumns({"_k": F.col("doc_id").cast("long"), "_kh": F.md5(text)})
    same = F.col("_k").eqNullSafe(F.col("_bad_id")) & (F.col("_kh") == F.col("_bad_hash"))
    return keyed.join(bad, same, "left_anti").drop("_k", "_kh")
