"""Benchmark decontamination by template canonicalisation.

Words of documents and benchmark items become hashes; numbers, names and units
become typed placeholders. Names are listed ones and, in a second template,
all words with a capital inside a sentence. Windows of the templates meet in a
hash join. Along one alignment the values behind the placeholders must map one
to one (consistent slots): a question with other numbers or names is caught,
two texts that merely share a pattern are not. Built-in expressions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Words of a window, and the share of an item's windows that make a leak.
WINDOW, SHARE = 5, 0.8
#: Benchmark windows up to this number are broadcast (some 100 bytes each).
BROADCAST_WINDOWS = 400_000

#: Different words, beside placeholders, that a window needs to tell anything.
WORDS = 3
#: Windows in a row (or all, of a shorter item) that make an alignment.
ALIGNED = 3

#: Tokens of an item that is shorter than a window, at least.
SHORT = 3

#: Scripts without spaces (Thai to Myanmar, Khmer, kana, ideographs): each character is a word.
_SINGLE = r"\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
_MARK = "\x01"
#: Before a capitalised word that follows a small letter, digit or comma and one space.
_INSIDE = r"\s(?<=[\p{Ll}0-9,;]\s)(?=\p{Lu}\p{Ll})"
_TOKEN = r"\x01?[a-z\x{80}-\x{10FFFF}][a-z0-9\x{80}-\x{10FFFF}]*|[0-9]+(?:[.,][0-9]+)*"

# Spelled numbers, units and given names that become placeholders in every template.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice".split()
# Spanish, French and German; without words that are common in another of the languages (once, cent, elf).
NUMBERS += (
    "dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil millón millones docena "
    "deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante mille millions douzaine "
    "zwei drei vier fünf sechs sieben acht neun zehn zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend millionen dutzend"
).split()
UNITS = (
    "mm cm km mg kg ml kb mb gb tb hz khz mhz ghz kw kwh mph kph ft yd lb lbs oz "
    "millimeter millimeters centimeter centimeters meter meters metre metres kilometer kilometers kilometre kilometres inch inches foot feet yard yards mile miles "
    "gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes liter liters litre litres milliliter milliliters gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years degree degrees celsius fahrenheit kelvin "
    "dollar dollars cent cents euro euros percent watt watts volt volts newton newtons joule joules "
    "milímetros centímetros metro metros kilómetro kilómetros gramo gramos kilo kilos kilogramo kilogramos litro litros segundo segundos minuto minutos hora horas día días semana semanas meses año años grados dólar dólares céntimos "
    "millimètres centimètres mètre mètres kilomètre kilomètres gramme grammes kilogramme kilogrammes secondes heure heures jour jours semaine semaines mois année années degrés centimes "
    "zentimeter kilometern gramm kilogramm sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren grad pfund"
).split()
NAMES = (
    "alice alan albert alex alexander amanda amy andrea andrew angela ann anna anne anthony ashley barbara ben benjamin betty bill bob brandon brian carl carla carlos carol "
    "caroline catherine charles charlie chris christine christopher claire clara daniel danielle david deborah dennis diana donald donna dorothy dylan edward elena elizabeth ella "
    "emily emma eric ethan eva evelyn frank fred gary george grace greg hannah harold harry heather helen henry isabella jack jacob jake james jane janet jason jean jeff jennifer "
    "jeremy jessica jim joan joe john jonathan jose joseph joshua juan judith judy julia julie justin karen katherine kathleen keith kelly kenneth kevin kim kyle larry laura lauren "
    "leah lily linda lisa louis lucas lucy luke madison margaret maria marie marilyn martha martin mary matthew megan melissa mia michael michelle mike mohammed nancy natalie nathan "
    "nicholas nicole noah nora olivia oliver oscar pamela patricia patrick paul peter philip rachel ralph raymond rebecca richard robert roger ronald rose roy russell ruth ryan sally sam "
    "samantha samuel sandra sara sarah scott sean sharon sophia sophie stephanie stephen steve steven susan teresa terry theresa thomas tim timothy tina tom tony tyler victoria vincent "
    "virginia walter wayne william zachary zoe"
).split()
#: What placeholders hash to; a word's hash is never one of them but by chance.
_NUMBER, _UNIT, _NAME = 1, 2, 3


def tokens(text: Column) -> Column:
    """Lower-cased words and numbers of a whole text, with a mark before those
    that have a capital inside a sentence; null has none."""
    text = F.translate(F.coalesce(text, F.lit("")), _MARK, " ")
    foreign = (F.octet_length(text) > F.length(text)) & text.rlike(f"[{_SINGLE}]")
    text = F.when(foreign, F.regexp_replace(text, f"[{_SINGLE}]", " $0 ")).otherwise(text)
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, _INSIDE, f"$0{_MARK}")), F.lit(_TOKEN), F.lit(0))


def _template(words: Column) -> Column:
    def code(w: Column) -> Column:
        listed = F.when(w.isin(*NUMBERS), F.lit(_NUMBER)).when(w.isin(*UNITS), F.lit(_UNIT)).otherwise(F.lit(_NAME)).cast("long")
        return F.when(w < "a", F.lit(_NUMBER).cast("long")).when(w.isin(*NUMBERS, *UNITS, *NAMES), listed).otherwise(F.xxhash64(w))

    return F.transform(words, code)


def _coded(df: DataFrame, keep: list[str]) -> DataFrame:
    """``words``, ``codes``, the ``slots`` behind placeholders, and where a text
    has names by form the same with them: ``formed``, ``formed_slots``."""
    df = df.select(*keep, tokens(F.col("text").cast("string")).alias("marked"))
    bare = F.when(F.exists("marked", lambda w: w.startswith(_MARK)), F.transform("marked", lambda w: F.ltrim(w, F.lit(_MARK)))).otherwise(F.col("marked"))
    df = df.select(*keep, "marked", bare.alias("words"))
    df = df.select(*keep, "marked", "words", _template(F.col("words")).alias("codes"))
    named = lambda m, c: F.when(m.startswith(_MARK) & (c != _UNIT) & (c != _NUMBER), F.lit(_NAME).cast("long")).otherwise(c)
    formed = F.when(F.exists("marked", lambda w: w.startswith(_MARK)), F.zip_with("marked", "codes", named))
    df = df.select(*keep, "words", "codes", formed.alias("formed"))
    slots = lambda codes: F.zip_with("words", codes, lambda w, c: F.when(c.between(_NUMBER, _NAME), w))
    return df.select(*keep, "words", "codes", slots("codes").alias("slots"), "formed", slots("formed").alias("formed_slots"))


def _windows(df: DataFrame, keep: list[str], size: int, whole: int = WINDOW) -> DataFrame:
    """``keep`` and ``at, window, slots, exact, by_form`` for each window of
    ``size`` codes. One without WORDS different words beside placeholders, or of
    less than ``whole`` codes, stands for its very tokens: ``exact``, without
    slots. A window that holds names by form comes once more, ``by_form``, if
    enough words are left."""
    n = F.size("codes")

    # Windows are hashed where they stand, by places: only those with a
    # placeholder are cut out, for their slots and different words.
    def made(places: Column, codes: str, slots: str, by_form: bool) -> Column:
        at = lambda i: [F.get(codes, i - 1 + k) for k in range(size)]
        held = lambda i: reduce(lambda a, b: a | b, [c.between(_NUMBER, _NAME) for c in at(i)])
        plain = lambda i: F.size(F.array_distinct(F.filter(F.slice(codes, i, size), lambda c: ~c.between(_NUMBER, _NAME))))
        exact = lambda i: held(i) & (plain(i) < WORDS) if whole == size else F.lit(True)
        template = lambda i: F.xxhash64(F.lit(size), *at(i))
        tokens_of = lambda i: F.xxhash64(F.lit(size), F.lit("exact"), F.slice("words", i, size))

        def window(i: Column) -> Column:
            cut = F.struct(i.alias("at"), F.when(exact(i), tokens_of(i)).otherwise(template(i)).alias("window"), F.when(~exact(i), F.array_compact(F.slice(slots, i, size))).alias("slots"), exact(i).alias("exact"), F.lit(by_form).alias("by_form"))
            if whole != size:
                return cut
            bare = F.struct(i.alias("at"), template(i).alias("window"), F.lit(None).cast("array<string>").alias("slots"), F.lit(False).alias("exact"), F.lit(by_form).alias("by_form"))
            return F.when(held(i), cut).otherwise(bare)

        return F.transform(places, window)

    starts = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
    windows = made(starts, "codes", "slots", False)
    if whole == size:
        other = lambda i: reduce(lambda a, b: a | b, [F.get("formed", i - 1 + k) != F.get("codes", i - 1 + k) for k in range(size)])
        some = F.filter(starts, other)
        formed = F.filter(made(some, "formed", "formed_slots", True), lambda w: ~w["exact"])
        windows = F.when(F.col("formed").isNotNull(), F.concat(windows, formed)).otherwise(windows)
    rows = df.select(*keep, F.explode(windows).alias("w"))
    return rows.select(*keep, "w.at", "w.window", F.coalesce("w.slots", F.array().cast("array<string>")).alias("slots"), "w.exact", "w.by_form")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item, size, place, window, item_slots, item_form, windows`` of each item's windows
    that have WORDS different words or no placeholder; of an item without such
    a window the exact ones, and of one of SHORT to ``window`` - 1 tokens all
    its tokens as one. Items equal in id and text are one."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    items = items.withColumn("item", F.struct("item_id", F.xxhash64("text").alias("hash")))
    coded = _coded(items, ["item"])
    rows = _windows(coded, ["item"], window, window).withColumn("size", F.lit(window))
    for size in range(SHORT, window):
        rows = rows.unionByName(_windows(coded.where(F.size("codes") == size), ["item"], size, window).withColumn("size", F.lit(size)))
    rows = rows.select("item", "size", F.col("at").alias("place"), "window", F.col("slots").alias("item_slots"), "exact", F.col("by_form").alias("item_form"))
    counts = rows.where("not item_form").groupBy("item").agg(F.count_if(~F.col("exact")).alias("usable"), F.count(F.lit(1)).alias("all"))
    rows = rows.join(counts, "item").where((F.col("usable") == 0) | ~F.col("exact"))
    rows = rows.where((F.col("usable") > 0) | ~F.col("item_form"))
    return rows.select("item", "size", "place", "window", "item_slots", "item_form", F.when(F.col("usable") > 0, F.col("usable")).otherwise(F.col("all")).alias("windows"))


def matches(docs: DataFrame, benchmark: DataFrame, keys: list[str], window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """``keys, item, matched, windows`` of documents that hold an item.

    ``matched`` counts the item's windows that the document has on alignments
    of ALIGNED windows or more with consistent slots; a row needs ``share`` of them. Rows that agree in
    ``keys`` are one document, so the keys should tell texts apart.
    """
    bench = written(item_windows(benchmark, window), "leak-items")
    short = sorted(r["size"] for r in bench.where(F.col("size") < window).select("size").distinct().collect())
    if bench.count() <= BROADCAST_WINDOWS:
        bench = F.broadcast(bench)
    coded = _coded(docs, keys)
    rows = _windows(coded, keys, window, window)
    for size in short:
        rows = rows.unionByName(_windows(coded, keys, size, window))
    found = rows.join(bench, "window")
    formed = F.col("by_form") | F.col("item_form")
    found = found.select(*keys, "item", "windows", "place", (F.col("at") - F.col("place")).alias("shift"), F.when(F.size("slots") > 0, F.arrays_zip("slots", "item_slots")).alias("pairs"), formed.alias("formed"))
    found = written(found.distinct(), "leak-found")
    # An alignment stands by the listed names alone, and once more with those by form.
    ways = F.when(F.col("formed"), F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True)))
    found = found.withColumn("formed", F.explode(ways))
    on = [*keys, "item", "shift", "formed"]
    same = reduce(lambda a, b: a & b, [F.col(f"f.{c}").eqNullSafe(F.col(f"x.{c}")) for c in on])
    pairs = found.where("pairs is not null").select(*on, F.explode("pairs").alias("p")).distinct()
    mixed = pairs.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p.slots").alias("a"), F.countDistinct("p.item_slots").alias("b")).where("n > a or n > b")
    sound = found.alias("f").join(mixed.alias("x"), same, "left_anti").select(*on, "windows", "place").distinct()
    aligned = sound.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*on)))
    aligned = aligned.where(F.col("n") >= F.least(F.lit(ALIGNED), F.col("windows")))
    out = aligned.groupBy(*keys, "item", "formed").agg(F.countDistinct("place").alias("matched"), F.first("windows").alias("windows"))
    out = out.groupBy(*keys, "item").agg(F.max("matched").alias("matched"), F.first("windows").alias("windows"))
    return out.where(F.col("matched") >= F.col("windows") * F.lit(share))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """One row for each document and item it holds: ``doc_id, item_id,
    matched, windows, similarity``. Repeated rows count once; rows of one id
    with other texts count apart; null and empty texts hold nothing, very long
    ones are read whole; other columns, whatever their names, are not read; an
    empty table on either side gives an empty result."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    found = matches(keyed, benchmark, ["doc_id", "hash"], window, share)
    return found.select("doc_id", "item.item_id", "matched", F.col("windows").cast("long").alias("windows"), (F.col("matched") / F.col("windows")).alias("similarity"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds an item; what a row's text
    holds decides alone, whatever its id, so repeated rows go or stay together
    and null texts stay. All columns of ``docs`` but ``_bw_hash`` and
    ``_bw_crc`` come back as they are."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumns({"_bw_hash": F.xxhash64(text), "_bw_crc": F.crc32(F.encode(text, "UTF-8"))})
    found = matches(keyed, benchmark, ["_bw_hash", "_bw_crc"])
    return keyed.join(written(found.select("_bw_hash", "_bw_crc").distinct(), "leak-texts"), ["_bw_hash", "_bw_crc"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
