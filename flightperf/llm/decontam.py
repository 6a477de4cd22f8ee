"""Benchmark decontamination by canonical templates.

A text is read as tokens: numbers and runs of letters. Numbers become the placeholder num, a
unit word right after a number becomes unit, a capitalised word inside a sentence becomes name;
other words are lower-cased. A re-parameterised question ("then Ann has 7 lb left" for "then Tom
has 12 kg left") has the template of the original. A capitalised word elsewhere (where a sentence,
line, quote or bracket starts) may be a name or not, so texts have a second reading in which it is
one too, unless it is one of ``STARTERS``; a pair that doesn't leak as first read leaks if it does
with windows of either reading. ``sql`` gives the first reading alone.

Windows of ``WINDOW`` template tokens of the documents are hash-joined with those of the benchmark
items (a shorter item is one window). A window of placeholders alone says little, so it is joined
by its slot values instead; with other values it counts only in an unbroken row with a matched
window that holds a word. Matched windows with the same alignment (document place less item place)
are one occurrence of the item. Its slots must be consistent: every slot value of the item stands
for one value in the document. Consistent occurrences whose alignments differ by no more than the
item's length, and that together cover ``COVERAGE`` of the item's windows, are a leak; an item
shorter than a window must agree in its slot values too. (``sql`` counts placeholder windows like
others and unites the occurrences of the whole document.)

All of it is DataFrame functions. The benchmark's windows are counted first and broadcast up to
``BROADCAST_WINDOWS`` (about 40 bytes each); beyond that both sides are shuffled by the hash.

Defined cases: null texts and texts without tokens have no window and leak nothing; repeated
documents are found each; repeated items are told apart by item_id; rows with a null doc_id or
item_id take part like others; an empty benchmark or document table gives no leak; extra columns
are ignored by ``leaks`` and kept by ``drop_leaks``, which drops rows by id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightperf.llm.common import fresh, written

WINDOW = 5
COVERAGE = 0.5
BROADCAST_WINDOWS = 1_000_000

UNITS = ("mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer "
         "kilometers mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter "
         "liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week "
         "weeks month months year years dollar dollars euro euros cent cents percent degrees mph kph kmh")

# capitalised where a sentence starts, and no names
STARTERS = ("a an the this that these those there here it its he she they we you i his her their our your my each every "
            "all some any many most more both few several no none one two three four five six seven eight nine ten "
            "who whom whose what which when where why how if then than so but and or nor for of in on at by to from with "
            "without within into onto over under after before during since until while because although though as about "
            "between among is are was were be been am do does did has have had can could will would shall should may "
            "might must not only also just let given suppose assume consider find compute calculate determine evaluate "
            "solve show prove write choose select explain describe name list yesterday today tomorrow now later first "
            "second third next last finally another other however therefore thus hence question answer")

# placeholders: private-use letters, so that they stay one token
NUM, UNIT, NAME = "\ue000", "\ue001", "\ue002"
START = "\ue003"                # before a word that is a name in the second reading only
_LETTER = r"[\p{L}\p{M}]"
_NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*"
_TOKEN = rf"{_NUMBER}|{_LETTER}+|[{NUM}-{NAME}]"
# (the look-ahead comes first: most characters fail there)
_NAMES = r"(?=\p{Lu})(?<=[\p{L}\p{M}0-9,][ \t])\p{Lu}[\p{Ll}\p{M}]+(?![\p{L}\p{M}])"
_STARTS = (rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}0-9])(?!(?i:{'|'.join(STARTERS.split())})(?!{_LETTER}))"
           rf"\p{{Lu}}[\p{{Ll}}\p{{M}}]+(?!{_LETTER})")
_UNITS = rf"{NUM}( *){START}?(?:{'|'.join(UNITS.split())})(?!{_LETTER})"


def marked(text: str):
    """Column of template tokens of a text column (null or empty: no tokens); START stands before
    the words that are names in the second reading only."""
    whole = F.coalesce(F.col(text), F.lit(""))
    t = F.replace(whole, F.lit(START), F.lit("\ue004"))
    t = F.regexp_replace(F.regexp_replace(t, _NAMES, f"{NAME} "), _STARTS, f"{START}$0")
    t = F.regexp_replace(F.lower(t), _NUMBER, f" {NUM} ")
    t = F.regexp_replace(t, _UNITS, f"{NUM} {UNIT} ")
    # placeholders stand apart as they are put in; those that the text has itself do not
    own = F.contains(whole, F.lit(NUM)) | F.contains(whole, F.lit(UNIT)) | F.contains(whole, F.lit(NAME))
    t = F.when(own, F.regexp_replace(t, rf"([{NUM}-{NAME}])", " $1 ")).otherwise(t)
    return F.filter(F.split(t, rf"[^a-z\p{{L}}\p{{M}}{NUM}-{START}]+"), lambda w: w != "")


def template(text: str):
    """Column of template tokens of a text column in the first reading."""
    return first_reading(marked(text))


def first_reading(tokens):
    return F.transform(tokens, lambda w: F.ltrim(w, F.lit(START)))


def second_reading(tokens):
    return F.transform(tokens, lambda w: F.when(w.startswith(START), F.lit(NAME)).otherwise(w))


def raw_tokens(text: str):
    """Column of the same tokens as written, lower-cased."""
    return F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({_TOKEN})"), 1),
                       lambda w: F.lower(w))


def _slot(x: str) -> str:
    return f"({x} >= '{NUM}' AND {x} <= '{NAME}')"


def _bare(tokens: str, i: str, width) -> str:
    """SQL: is the window of ``tokens`` at place ``i`` made of placeholders alone?"""
    return f"({_slot(f'{tokens}[{i}]')} AND forall(slice({tokens}, {i} + 1, {width}), x -> {_slot('x')}))"


def windows(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` without ``tpl``, ``named`` (the two readings) and ``text``, one row a window: its place
    (from 0), hash and reading (``second``; windows that both readings share are of the first alone).
    Windows of placeholders alone are hashed by their slot values."""
    # each token is hashed once, a window from the hashes of its tokens
    def hashed(tokens, i, bare):
        plain = f"xxhash64({', '.join(f'{tokens}_hash[{i} + {k}]' for k in range(width))})"
        return f"if({_bare(tokens, i, width)}, xxhash64(slice(raw, {i} + 1, {width}), true), {plain})" if bare else plain

    def both(bare):
        # windows of the second reading: those over a word that it reads otherwise
        other = (f"array_distinct(flatten(transform(filter(sequence(0, size(tpl) - 1), p -> tpl_hash[p] <> named_hash[p]), "
                 f"p -> sequence(greatest(0, p - {width - 1}), least(p, size(tpl) - {width})))))")
        return f"""concat(
            transform(sequence(0, size(tpl) - {width}), i -> struct(i AS at, {hashed('tpl', 'i', bare)} AS window, false AS second)),
            transform({other}, i -> struct(i AS at, {hashed('named', 'i', bare)} AS window, true AS second)))"""
    rows = rows.withColumns({f"{c}_hash": F.transform(c, lambda w: F.xxhash64(w)) for c in ("tpl", "named")})
    some_bare = F.concat(F.array_join("named", " "), F.lit(" ")).rlike(f"(?:[{NUM}-{NAME}] ){{{width}}}")
    rows = rows.withColumn("raw", F.when(some_bare, raw_tokens("text")))
    found = F.expr(f"CASE WHEN size(tpl) < {width} THEN array() WHEN raw IS NULL THEN {both(False)} ELSE {both(True)} END")
    return rows.select(*[c for c in rows.columns if c not in ("tpl", "named", "text", "raw", "tpl_hash", "named_hash")], F.inline(found))


def _items(benchmark: DataFrame, width: int) -> DataFrame:
    """Distinct items: item_id, item_digest, text, both readings, raw, n (tokens), width, n_windows."""
    items = benchmark.select("item_id", "text").distinct().select(
        "item_id", F.xxhash64("text").alias("item_digest"), "text", marked("text").alias("tokens"), raw_tokens("text").alias("item_raw"))
    items = items.select("item_id", "item_digest", "text", first_reading("tokens").alias("item_tpl"),
                         second_reading("tokens").alias("item_named"), "item_raw")
    items = items.withColumn("n_tokens", F.size("item_tpl")).where("n_tokens > 0")
    items = (items.withColumn("width", F.least("n_tokens", F.lit(width)))
             .withColumn("item_windows", F.col("n_tokens") - F.col("width") + 1))
    for name in ("tpl", "named"):                       # places of windows of placeholders alone
        items = items.withColumn(f"bare_{name}", F.expr(
            f"filter(sequence(0, item_windows - 1), p -> {_bare(f'item_{name}', 'p', 'width')})"))
    return items


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, coverage: float = COVERAGE,
          broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per leak: doc_id, text_digest, item_id, matched windows, item windows, slots."""
    items = written(_items(benchmark, width), "decontam-items")
    sizes = [r["width"] for r in items.groupBy("width").agg(F.sum("item_windows").alias("n")).collect()]
    n_windows = items.agg(F.sum("item_windows")).first()[0] or 0
    tokens = docs.select("doc_id", F.xxhash64("text").alias("text_digest"), "text", marked("text").alias("tokens")).select(
        "doc_id", "text_digest", "text", first_reading("tokens").alias("tpl"), second_reading("tokens").alias("named"))
    found = None
    for w in sorted(sizes) or [width]:                  # at most ``width`` different sizes
        mine = windows(items.where(F.col("width") == w).select(
            "item_id", "item_digest", "text", F.col("item_tpl").alias("tpl"), F.col("item_named").alias("named")), w)
        mine = mine.withColumnsRenamed({"at": "item_at", "second": "item_second"})
        if 2 * n_windows <= broadcast_windows:          # a window has two readings at most
            mine = F.broadcast(mine)
        part = windows(tokens, w).join(mine, "window").select(
            "doc_id", "text_digest", "item_id", "item_digest", (F.col("at") - F.col("item_at")).alias("shift"), "item_at",
            (F.col("second") | F.col("item_second")).alias("second"))
        found = part if found is None else found.unionByName(part)
    pair = ["doc_id", "text_digest", "item_id", "item_digest"]
    runs = found.groupBy(*pair, "shift").agg(F.collect_set(F.when(~F.col("second"), F.col("item_at"))).alias("first_places"),
                                             F.collect_set("item_at").alias("places"))
    # pairs that could reach the coverage, before the documents' slots are looked at
    counted = runs.groupBy(*pair).agg(F.collect_list(F.struct("shift", "first_places", "places")).alias("runs"))
    counted = counted.alias("l").join(items.alias("r"), _same("item_id", "item_digest")).select(
        "l.*", "r.width", "r.item_windows", "r.n_tokens", "r.item_tpl", "r.item_named", "r.item_raw",
        "r.bare_tpl", "r.bare_named")
    total = F.size(F.array_distinct(F.flatten(F.transform("runs", lambda r: r["places"]))))
    pairs = written(counted.where(total + F.size("bare_named") >= F.lit(coverage) * F.col("item_windows")), "decontam-pairs")
    keys = written(pairs.select("doc_id", "text_digest").distinct(), "decontam-keys")
    texts = (docs.select("doc_id", F.xxhash64("text").alias("text_digest"), "text").alias("l")
             .join(keys.alias("r"), _same("doc_id", "text_digest"), "left_semi")
             .dropDuplicates(["doc_id", "text_digest"])
             .select("doc_id", "text_digest", raw_tokens("text").alias("doc_raw"), marked("text").alias("tokens"))
             .select("doc_id", "text_digest", "doc_raw", first_reading("tokens").alias("doc_tpl"),
                     second_reading("tokens").alias("doc_named")))
    joined = pairs.alias("l").join(texts.alias("r"), _same("doc_id", "text_digest")).select(
        "l.*", "r.doc_raw", "r.doc_tpl", "r.doc_named")
    joined = _judged(joined, "first", "tpl", "first_places", ("tpl",), width)
    joined = _judged(joined, "either", "named", "places", ("tpl", "named"), width)
    enough = {k: F.col(f"{k}_windows") >= F.lit(coverage) * F.col("item_windows") for k in ("first", "either")}

    def of(what):
        return F.when(enough["first"], F.col(f"first_{what}")).otherwise(F.col(f"either_{what}"))
    return joined.where(enough["first"] | enough["either"]).select(
        "doc_id", "text_digest", "item_id", of("windows").alias("n_windows"), "item_windows", of("slots").alias("n_slots"))


def _judged(pairs: DataFrame, name: str, reading: str, places: str, doc_readings, width: int) -> DataFrame:
    """``pairs`` with the windows and slots of their consistent occurrences, as ``name``_windows and
    ``name``_slots; ``places``: the field of ``runs`` with the windows matched in this reading."""
    tpl, bare = f"item_{reading}", f"bare_{reading}"
    alike = " OR ".join(f"slice(doc_{d}, p + r.shift + 1, width) = slice({tpl}, p + 1, width)" for d in doc_readings)
    # windows of placeholders alone, of the item's template but other values; and those of them in a
    # row with a matched window that holds a word
    runs = F.expr(f"""transform(filter(runs, r -> size(r.{places}) > 0), r -> struct(r.shift AS shift, r.{places} AS places,
        filter({bare}, p -> NOT array_contains(r.{places}, p) AND p + r.shift >= 0 AND ({alike})) AS more))""")
    grown = F.expr(f"""transform(occurrences, r -> struct(r.shift AS shift, concat(r.places, filter(r.more, p ->
        exists(r.places, q -> NOT array_contains({bare}, q)
               AND forall(sequence(p, q), m -> array_contains(r.places, m) OR array_contains(r.more, m))))) AS places))""")
    # slots of an occurrence: placeholders of the item under its matched windows
    slots = F.expr(f"""transform(occurrences, r -> struct(r.shift AS shift, r.places AS places, transform(
        filter(sequence(0, n_tokens - 1), p -> {_slot(f'{tpl}[p]')} AND exists(r.places, q -> q <= p AND p < q + width)),
        p -> struct(item_raw[p] AS item, doc_raw[p + r.shift] AS doc)) AS slots))""")
    ok = (f"size(array_distinct(r.slots)) = size(array_distinct(transform(r.slots, s -> s.item))) "
          f"AND (n_tokens >= {width} OR NOT exists(r.slots, s -> s.item <> s.doc))")
    passed = (pairs.withColumn("occurrences", runs).withColumn("occurrences", grown).withColumn("occurrences", slots)
              .withColumn("passed", F.expr(f"array_sort(filter(occurrences, r -> {ok}))")))
    # the most windows of alignments that differ by no more than the item's length: along the
    # alignments, the last one that each window was matched at
    most = F.expr("""aggregate(passed, struct(0 AS n, array_repeat(CAST(NULL AS INT), item_windows) AS last), (s, r) ->
        transform(array(transform(s.last, (x, p) -> if(array_contains(r.places, p), r.shift, x))), l ->
                  struct(greatest(s.n, size(filter(l, x -> x >= r.shift - n_tokens))) AS n, l AS last))[0], s -> s.n)""")
    return (passed.withColumn(f"{name}_windows", most)
            .withColumn(f"{name}_slots", F.expr("aggregate(passed, 0, (n, r) -> greatest(n, size(r.slots)))"))
            .drop("occurrences", "passed"))


def _same(a: str, b: str):
    return F.col(f"l.{a}").eqNullSafe(F.col(f"r.{a}")) & (F.col(f"l.{b}") == F.col(f"r.{b}"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the rows that leak an item."""
    bad = written(leaks(docs, benchmark, width, coverage).select("doc_id", "text_digest").distinct(), "decontam-leaks")
    digest = fresh(docs, "text_digest")
    keyed = docs.withColumn(digest, F.xxhash64("text"))
    return keyed.alias("l").join(
        bad.select("doc_id", F.col("text_digest").alias(digest)).alias("r"),
        _same("doc_id", digest), "left_anti").select(*[F.col(f"l.`{c}`") for c in docs.columns])


def sql(width: int = WINDOW, coverage: float = COVERAGE) -> str:
    """DuckDB SQL for the rows of op7."""
    units = "|".join(UNITS.split())
    mark_name = r"([\p{L}\p{M}0-9,][ \t])(\p{Lu}[\p{Ll}\p{M}])"
    marked = "coalesce(text, '')"
    for _ in range(2):                                  # twice: a two-letter name hides the next one
        marked = f"regexp_replace({marked}, '{mark_name}', '\\1\ue003\\2', 'g')"
    marked = f"regexp_replace({marked}, '([0-9] *)((?i:{units}))([^\\p{{L}}\\p{{M}}]|$)', '\\1\ue004\\2\\3', 'g')"
    token = rf"[\x{{e003}}\x{{e004}}]?(?:{_NUMBER}|{_LETTER}+|[\x{{e000}}-\x{{e002}}])"
    return f"""
WITH src AS (SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS rn, {marked} AS t FROM documents
             UNION ALL SELECT 'i', item_id, row_number() OVER (), {marked} FROM (SELECT DISTINCT item_id, text FROM benchmark)),
tok AS (SELECT kind, id, rn, regexp_extract_all(t, '{token}') AS m FROM src),
tpl AS (SELECT kind, id, rn, list_transform(m, lambda w: lower(regexp_replace(w, '[\\x{{e003}}\\x{{e004}}]', ''))) AS raw,
        list_transform(m, lambda w: CASE
            WHEN regexp_matches(w, '^\\x{{e003}}\\p{{Lu}}[\\p{{Ll}}\\p{{M}}]+$') THEN '{NAME}'
            WHEN w[1] = '\ue004' THEN '{UNIT}' WHEN regexp_matches(w, '^\\x{{e003}}?[0-9]') THEN '{NUM}'
            ELSE lower(regexp_replace(w, '[\\x{{e003}}\\x{{e004}}]', '')) END) AS tpl FROM tok),
item AS (SELECT id, rn, raw, tpl, least(len(tpl), {width}) AS width, len(tpl) - least(len(tpl), {width}) + 1 AS n
         FROM tpl WHERE kind = 'i' AND len(tpl) > 0),
iw AS (SELECT id, rn, width, pos, array_to_string(tpl[pos + 1:pos + width], ' ') AS win
       FROM (SELECT *, unnest(range(n)) AS pos FROM item)),
dw AS (SELECT id, rn, width, pos, array_to_string(tpl[pos + 1:pos + width], ' ') AS win
       FROM (SELECT d.id, d.rn, d.tpl, w.width, unnest(range(len(d.tpl) - w.width + 1)) AS pos
             FROM tpl d, (SELECT DISTINCT width FROM item) w WHERE d.kind = 'd')),
hit AS (SELECT DISTINCT dw.rn AS d, iw.rn AS i, dw.pos - iw.pos AS shift, iw.pos FROM dw JOIN iw USING (win, width)),
pair AS (SELECT d, i FROM hit JOIN item ON item.rn = hit.i GROUP BY d, i, item.n
         HAVING count(DISTINCT pos) >= {coverage} * item.n),
slot AS (SELECT DISTINCT d, i, shift, p, it.raw[p + 1] AS iv, dt.raw[p + shift + 1] AS dv
         FROM (SELECT hit.d, hit.i, hit.shift, unnest(range(hit.pos, hit.pos + item.width)) AS p
               FROM hit JOIN pair USING (d, i) JOIN item ON item.rn = hit.i)
         JOIN item it ON it.rn = i JOIN tpl dt ON dt.kind = 'd' AND dt.rn = d
         WHERE it.tpl[p + 1] BETWEEN '{NUM}' AND '{NAME}'),
verdict AS (SELECT d, i, shift, count(*) AS slots, count(DISTINCT (iv, dv)) = count(DISTINCT iv) AS ok,
                   bool_and(iv = dv) AS same FROM slot GROUP BY ALL),
good AS (SELECT hit.d, hit.i, hit.shift, hit.pos, coalesce(v.slots, 0) AS slots
         FROM hit JOIN pair USING (d, i) JOIN item ON item.rn = hit.i LEFT JOIN verdict v USING (d, i, shift)
         WHERE coalesce(v.ok, true) AND (len(item.tpl) >= {width} OR coalesce(v.same, true)))
SELECT dt.id AS doc_id, it.id AS item_id, CAST(count(DISTINCT good.pos) AS INTEGER) AS n_windows,
       CAST(it.n AS INTEGER) AS item_windows, CAST(max(slots) AS INTEGER) AS n_slots
FROM good JOIN item it ON it.rn = good.i JOIN tpl dt ON dt.kind = 'd' AND dt.rn = good.d
GROUP BY good.d, good.i, dt.id, it.id, it.n HAVING count(DISTINCT good.pos) >= {coverage} * it.n"""
