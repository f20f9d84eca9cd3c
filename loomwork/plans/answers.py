"""Registered queries of the answer parsers on noisy texts made of the tables; their SQL computes the answers anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import judges, parsers
from loomwork.operators import metrics
from loomwork.plans.catalog import query
from loomwork.plans.tables import Tables


def _c(name: str) -> Column:
    return F.col(name)


def _hash(key: str, salt: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", _c(key).cast("string"), F.lit(salt)).cast("binary")), 1, 8), 16, 10).cast("bigint")


def _pick(key: str, salt: str, values: list) -> Column:
    items = F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values])
    return F.get(items, (_hash(key, salt) % len(values)).cast("int"))


def _sql_hash(key: str, salt: str, n: int) -> str:
    return f"(('0x' || left(md5({key}::VARCHAR || ':{salt}'), 8))::BIGINT % {n})"


def _sql_pick(key: str, salt: str, values: list[str]) -> str:
    return f"[{', '.join(values)}][1 + {_sql_hash(key, salt, len(values))}]"


def _text(c: str) -> Column:
    return _c(c).cast("string")


_BARE = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_NUMBER = r"regexp_full_match(lower({}), '[+-]?(\d+(_\d+)*\.?\d*|\.\d+)(e[+-]?\d+)?|[+-]?(nan|inf|infinity)')"


# --- numbers with units, separators, line feeds

_NOISY_NUMBERS = [
    "p_size::VARCHAR", "p_size || 'd'", "p_size || 'D'", "' ' || p_retailprice || chr(10)", "'1,' || lpad((p_size * 7 % 1000)::VARCHAR, 3, '0')", "p_size || 'e2'", "'nan'", "p_name",
    "p_size || '.00'", "'-' || p_retailprice || chr(9)", "''", "p_size || 'f'", "upper(p_name)", "'1_' || p_size", "chr(13) || p_size || '.5 '", "'.' || p_size", "p_size || '..'", "'x'",
]


def _noisy_number() -> Column:
    size, price, name = _text("p_size"), _text("p_retailprice"), _c("p_name")
    return _pick("p_partkey", "number", [
        size, F.concat(size, F.lit("d")), F.concat(size, F.lit("D")), F.concat(F.lit(" "), price, F.lit("\n")), F.concat(F.lit("1,"), F.lpad((_c("p_size") * 7 % 1000).cast("string"), 3, "0")), F.concat(size, F.lit("e2")), "nan", name,
        F.concat(size, F.lit(".00")), F.concat(F.lit("-"), price, F.lit("\t")), "", F.concat(size, F.lit("f")), F.upper(name), F.concat(F.lit("1_"), size), F.concat(F.lit("\r"), size, F.lit(".5 ")), F.concat(F.lit("."), size), F.concat(size, F.lit("..")), "x",
    ])


_NUMBERS = f"""WITH t AS (SELECT p_partkey, {_sql_pick('p_partkey', 'number', _NOISY_NUMBERS)} AS s FROM part), b AS (SELECT p_partkey, s, {_BARE.format('s')} AS bare FROM t),
n AS (SELECT *, replace(bare, ',', '') AS plain, {_NUMBER.format("replace(bare, ',', '')")} AS number FROM b), v AS (SELECT *, CASE WHEN number THEN replace(plain, '_', '')::DOUBLE END AS v FROM n)"""


@query(_NUMBERS + f""" SELECT p_partkey, number AS is_number, CASE WHEN isnan(v) THEN ['#NaN'] WHEN number THEN ['#' || round_even(v, 2)] WHEN length(bare) = 1 THEN [' ' || lower(bare), lower(bare) || ' '] ELSE [lower(bare)] END AS forms,
 contains(s, '.') AND {_NUMBER.format('bare')} AS float_text, regexp_full_match(regexp_replace(bare, '\\.0+$', ''), '[+-]?\\d+') AS digits, coalesce(abs(v - 25) / 25 <= 0.05, false) AND NOT contains(bare, ',') AS near_25 FROM v""")
def numbers_and_units(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey", _noisy_number().alias("s"))
    s = _c("s")
    return p.select(
        "p_partkey", parsers.is_number(s).alias("is_number"), parsers.normal_forms(s).alias("forms"), parsers.is_float_string(s).alias("float_text"), parsers.is_digit_string(s).alias("digits"),
        F.coalesce(metrics.relaxed_match(s, F.lit("25")), F.lit(False)).alias("near_25"),
    )


# --- answers that end in white space

_ENDED = ["p_type", "lower(p_type) || chr(10)", "' ' || p_type || chr(9)", "p_type || 's'", "''", "chr(11) || p_name || chr(12)"]


@query(f"""WITH t AS (SELECT p_partkey, p_type, p_name, {_sql_pick('p_partkey', 'ended', _ENDED)} AS s FROM part), b AS (SELECT *, lower(regexp_replace(s, '^[\\x09-\\x0d ]+|[\\x09-\\x0d ]+$', '', 'g')) AS p FROM t),
d AS (SELECT *, greatest(1 - levenshtein(p, lower(p_type)) / greatest(length(p), length(p_type)), 1 - levenshtein(p, lower(p_name)) / greatest(length(p), length(p_name))) AS best FROM b)
SELECT p_partkey, p IN (lower(p_type), lower(p_name)) AS hit, round(CASE WHEN best < 0.5 THEN 0.0 ELSE best END, 6) AS anls FROM d""")
def answers_with_line_feeds(t: Tables) -> DataFrame:
    kind = _c("p_type")
    s = _pick("p_partkey", "ended", [kind, F.concat(F.lower(kind), F.lit("\n")), F.concat(F.lit(" "), kind, F.lit("\t")), F.concat(kind, F.lit("s")), "", F.concat(F.lit("\x0b"), _c("p_name"), F.lit("\x0c"))])
    right = F.array("p_type", "p_name")
    return t.part.select("p_partkey", metrics.exact_match(s, right).alias("hit"), F.round(metrics.anls(s, right), 6).alias("anls"))


# --- choices

_OPTIONS = "['A', 'B', 'C', 'D']"
_CONTENTS = "[p_name, p_type, p_brand, 'box ' || p_size]"
_L1, _L2 = (f"{_OPTIONS}[1 + {_sql_hash('p_partkey', s, 4)}]" for s in ("one", "two"))
_C1, _C2 = (f"{_CONTENTS}[1 + {_sql_hash('p_partkey', s, 4)}]" for s in ("one", "two"))
_REPLIES = [
    f"'(' || {_L1} || ') or rather (' || {_L2} || ').'", f"{_L1} || '!'", f"'I say ' || {_L1} || ' , no ' || {_L2} || ' is it ?'", f"'After all it must be the ' || upper({_C1}) || ' rather than ' || {_C2} || ' there'",
    f"'the ' || {_C1}", f"'Not ' || {_L1} || ' but (' || {_L2} || ')'", "'no idea'", f"';' || {_L1} || ';'",
]


@query(f"""WITH t AS (SELECT p_partkey, {_CONTENTS} AS contents, {_sql_pick('p_partkey', 'reply', _REPLIES)} AS s FROM part), p AS (SELECT *, ' ' || trim(s, ',.!?;:''') || ' ' AS x FROM t),
f AS (SELECT p_partkey, x, kind, l, CASE WHEN contains(y, form) THEN length(y) - strpos(reverse(y), reverse(form)) - length(form) + 1 ELSE -1 END AS place FROM (
 SELECT p_partkey, x, kind, l, CASE WHEN kind = 3 THEN lower(x) ELSE x END AS y, CASE kind WHEN 1 THEN '(' || {_OPTIONS}[l] || ')' WHEN 2 THEN ' ' || {_OPTIONS}[l] || ' ' ELSE lower(contents[l]) END AS form FROM p, unnest([1, 2, 3, 4]) a(l), unnest([1, 2, 3]) b(kind))),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY kind, place DESC, l) AS r FROM f WHERE place >= 0 AND (kind < 3 OR len(list_filter(string_split_regex(x, '\\s+'), lambda w: w <> '')) > 5))
SELECT p.p_partkey, coalesce({_OPTIONS}[l], '?') AS choice FROM p LEFT JOIN r ON p.p_partkey = r.p_partkey AND r = 1""")
def multiple_choice(t: Tables) -> DataFrame:
    """Replies that name one option or two, in several forms; where none is named the guess is only told to be one of the letters."""
    letters = F.array(*map(F.lit, "ABCD"))
    contents = F.array("p_name", "p_type", "p_brand", F.concat(F.lit("box "), _text("p_size")))
    at = lambda items, salt: F.get(items, (_hash("p_partkey", salt) % 4).cast("int"))
    one, two, c1, c2 = at(letters, "one"), at(letters, "two"), at(contents, "one"), at(contents, "two")
    said = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    s = _pick("p_partkey", "reply", [
        said("(", one, ") or rather (", two, ")."), said(one, "!"), said("I say ", one, " , no ", two, " is it ?"), said("After all it must be the ", F.upper(c1), " rather than ", c2, " there"),
        said("the ", c1), said("Not ", one, " but (", two, ")"), "no idea", said(";", one, ";"),
    ])
    p = t.part.select("p_partkey", s.alias("s"), F.map_from_arrays(letters, contents).alias("options"))
    found = parsers.multiple_choice(_c("s"), _c("options"), _c("p_partkey"))
    nothing = (_c("s") == "no idea") | (_c("s").startswith("the ") & (F.size(F.split("s", r"\s+")) <= 5))
    return p.select("p_partkey", F.when(nothing & F.array_contains(F.map_keys("options"), found), F.lit("?")).otherwise(found).alias("choice"))


_SAID = ["'B'", "'q'", "'A) it is'", "'surely ' || p_type || ' or ' || p_name", "'zz ' || p_size", "''", "'Dear me, ' || p_brand"]


@query(f"""WITH t AS (SELECT p_partkey, p_name, p_type, p_brand, {_sql_pick('p_partkey', 'said', _SAID)} AS s FROM part)
SELECT p_partkey, CASE WHEN s = '' THEN 'none' WHEN length(s) = 1 OR s[1] IN ('A', 'B', 'C') THEN s[1] WHEN contains(s, p_name) THEN 'A' WHEN contains(s, p_type) THEN 'B' WHEN contains(s, p_brand) THEN 'C' ELSE s END AS named FROM t""")
def option_of(t: Tables) -> DataFrame:
    options = F.create_map(F.lit("A"), _c("p_name"), F.lit("B"), _c("p_type"), F.lit("C"), _c("p_brand"))
    s = _pick("p_partkey", "said", ["B", "q", "A) it is", F.concat(F.lit("surely "), "p_type", F.lit(" or "), "p_name"), F.concat(F.lit("zz "), _text("p_size")), "", F.concat(F.lit("Dear me, "), "p_brand")])
    return t.part.select("p_partkey", parsers.option_of(s, options, "none").alias("named"))


_EXTRACTED = ["'it is (' || lower(l) || ') then'", "l || chr(10)", "' ' || l || ' '", "substr(p_type, 2)", "p_name || '!'", "'(z)'", "p_size || 'd'", "' ' || p_retailprice || chr(10)", "'-' || p_size || '.75'", "'many'"]


@query(f"""WITH t AS (SELECT p_partkey, [p_name, p_type, p_brand] AS c, p_size % 4 AS k, {_sql_pick('p_partkey', 'extracted', [x.replace('l ', 'chr(65 + (p_partkey % 3)::INTEGER) ').replace('lower(l)', 'lower(chr(65 + (p_partkey % 3)::INTEGER))') if ' l ' in f' {x} ' or 'lower(l)' in x else x for x in _EXTRACTED])} AS s FROM part),
b AS (SELECT *, {_BARE.format('s')} AS bare FROM t), n AS (SELECT *, CASE WHEN regexp_matches(bare, '\\([a-zA-Z]\\)') THEN upper(regexp_extract(bare, '\\(([a-zA-Z])\\)', 1)) ELSE bare END AS named,
 CASE WHEN {_NUMBER.format('bare')} THEN bare::DOUBLE END AS v FROM b),
d AS (SELECT *, list_transform(c, lambda x: levenshtein(named, x)) AS far FROM n)
SELECT p_partkey, CASE WHEN k < 2 THEN CASE WHEN named IN ('A', 'B', 'C') THEN c[ascii(named) - 64] ELSE c[list_position(far, list_min(far))] END
 WHEN k = 2 THEN trunc(v)::BIGINT::VARCHAR ELSE round_even(v, 1)::VARCHAR END AS norm FROM d""")
def normalised_answers(t: Tables) -> DataFrame:
    letter = F.char((65 + _c("p_partkey") % 3).cast("int"))
    say = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    s = _pick("p_partkey", "extracted", [
        say("it is (", F.lower(letter), ") then"), say(letter, "\n"), say(" ", letter, " "), F.expr("substr(p_type, 2)"), say(_c("p_name"), "!"), "(z)", say(_text("p_size"), "d"), say(" ", _text("p_retailprice"), "\n"), say("-", _text("p_size"), ".75"), "many",
    ])
    k = _c("p_size") % 4
    kind = F.when(k < 2, F.lit("multi_choice")).otherwise(F.lit("free_form"))
    answer = F.when(k == 2, F.lit("integer")).otherwise(F.lit("float"))
    return t.part.select("p_partkey", parsers.normalised_answer(s, F.array("p_name", "p_type", "p_brand"), kind, answer, F.lit(1)).alias("norm"))


_QUICK = ["p_type", "' ' || p_size || chr(10)", "'+' || p_size", "p_retailprice || ''", "p_size || 'd'", "'So: the Answer:  ' || p_name || ' ' || chr(10) || 'no more'", "'Final answer: ' || p_brand || ' answer: x'", "''", "p_name"]


@query(f"""WITH t AS (SELECT p_partkey, p_type, p_size % 3 AS k, {_sql_pick('p_partkey', 'quick', _QUICK)} AS s FROM part), b AS (SELECT *, {_BARE.format('s')} AS bare FROM t)
SELECT p_partkey, CASE WHEN s = '' THEN '' WHEN k = 0 AND s = p_type THEN s WHEN k = 1 AND regexp_full_match(bare, '[+-]?\\d+') THEN bare::BIGINT::VARCHAR WHEN k = 2 AND {_NUMBER.format('bare')} THEN bare::DOUBLE::VARCHAR
 WHEN regexp_matches(lower(s), '(final answer:|answer:)') THEN {_BARE.format("regexp_extract(s, '(?i)(Final answer:|Answer:)\\s*(.*)', 2)")} ELSE s END AS taken FROM b""")
def quick_extract(t: Tables) -> DataFrame:
    say = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    s = _pick("p_partkey", "quick", [_c("p_type"), say(" ", _text("p_size"), "\n"), say("+", _text("p_size")), _text("p_retailprice"), say(_text("p_size"), "d"), say("So: the Answer:  ", _c("p_name"), " \nno more"), say("Final answer: ", _c("p_brand"), " answer: x"), "", _c("p_name")])
    k = _c("p_size") % 3
    kind = F.when(k == 0, F.lit("multi_choice")).otherwise(F.lit("free_form"))
    answer = F.when(k == 1, F.lit("integer")).when(k == 2, F.lit("float")).otherwise(F.lit("text"))
    return t.part.select("p_partkey", parsers.quick_extract(s, F.array("p_type", "p_brand"), kind, answer).alias("taken"))


# --- numbers and answers in running text

_PIECES = ["'1,' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0')", "(o_orderkey % 7) || '.5e-3'", "(o_orderkey % 50) || '.25'", "'-' || (1 + o_orderkey % 9)", "'word'", "(o_orderkey % 97)::VARCHAR", "'x' || (o_orderkey % 5)"]
# digits behind a comma are read again as a plain number, as are those around the dot of a number with an exponent


@query(f"""WITH w AS (SELECT o_orderkey, j, [{', '.join(_PIECES)}][1 + k] AS piece, k FROM (SELECT o_orderkey, j, ('0x' || left(md5(o_orderkey || ':piece' || j), 8))::BIGINT % {len(_PIECES)} AS k FROM orders, range(0, 5) r(j)))
SELECT o_orderkey, list_concat(list_concat(coalesce(list(piece ORDER BY j) FILTER (k = 0), []), coalesce(list(piece ORDER BY j) FILTER (k = 1), [])),
 coalesce(flatten(list(CASE k WHEN 0 THEN [string_split(piece, ',')[2]] WHEN 1 THEN [piece[1], '-3'] WHEN 6 THEN [piece[2:]] ELSE [piece] END ORDER BY j) FILTER (k <> 4)), [])) AS found FROM w GROUP BY o_orderkey""")
def numbers_in_text(t: Tables) -> DataFrame:
    """Five pieces a text: numbers with separators, with exponents, plain and signed ones, words, and digits behind a letter."""
    k = lambda n: (_c("o_orderkey") % n).cast("string")
    pieces = F.array(F.concat(F.lit("1,"), F.lpad(k(1000), 3, "0")), F.concat(k(7), F.lit(".5e-3")), F.concat(k(50), F.lit(".25")), F.concat(F.lit("-"), (1 + _c("o_orderkey") % 9).cast("string")), F.lit("word"), k(97), F.concat(F.lit("x"), k(5)))
    chosen = [F.get(pieces, (_hash("o_orderkey", f"piece{j}") % len(_PIECES)).cast("int")) for j in range(5)]
    return t.orders.select("o_orderkey", parsers.numbers(F.concat_ws(" ", *chosen)).alias("found"))


_LINES = ["'so the ' || o_orderkey || ' final result is ' || (o_orderkey % 40) || '.5'", "'Thus x = ' || (o_orderkey % 12)", "'Could be ' || o_orderpriority || '.'", "o_orderkey || ' it stays'", "'The answer IS B'", "'is :'", "'y = 3 so 1 = ' || (o_orderkey % 9) || chr(9)"]
_PHRASES = "['could be ', 'so ', 'is ', 'thus ', 'therefore ', 'final ', 'answer ', 'result ']"


@query(f"""WITH t AS (SELECT o_orderkey, {_sql_pick('o_orderkey', 'first', _LINES)} || chr(10) || {_sql_pick('o_orderkey', 'second', _LINES)} || {_sql_pick('o_orderkey', 'end', ["''", "' ' || chr(10)", "'.'"])} AS s FROM orders),
w AS (SELECT o_orderkey, trim(lower({_BARE.format('s')}), '.') AS whole FROM t), l AS (SELECT o_orderkey, whole, string_split(whole, chr(10)) AS lines FROM w),
a AS (SELECT o_orderkey, whole, i, list_filter(list_transform(list_concat({_PHRASES}, CASE WHEN i = len(lines) THEN ['='] ELSE [] END), lambda p: CASE WHEN contains(lines[i], p) THEN {_BARE.format("string_split(lines[i], p)[-1]")} END), lambda x: x IS NOT NULL AND x <> '') AS tails FROM l, unnest(range(1, len(lines) + 1)) r(i)),
k AS (SELECT o_orderkey, whole, i, list_filter(tails, lambda x: length(x) = list_min(list_transform(tails, lambda y: length(y))))[1] AS tail FROM a),
g AS (SELECT o_orderkey, any_value(whole) AS whole, coalesce(list(tail ORDER BY i) FILTER (tail IS NOT NULL AND tail NOT IN (':', ',', '.', '!', '?', ';', '''')), []) AS keys FROM k GROUP BY o_orderkey),
h AS (SELECT o_orderkey, CASE WHEN len(keys) > 0 THEN keys ELSE [whole] END AS keys FROM g), n AS (SELECT o_orderkey, list_concat(keys, flatten(list_transform(keys, lambda x: regexp_extract_all(x, '-?(?:\\d+\\.\\d+|\\d+)')))) AS texts FROM h),
f AS (SELECT o_orderkey, list_distinct(flatten(list_transform(texts, lambda x: CASE WHEN {_NUMBER.format("x")} THEN ['#' || round_even(TRY_CAST(x AS DOUBLE), 2)] WHEN length(x) = 1 THEN [' ' || x, x || ' '] ELSE [x] END))) AS forms FROM n)
SELECT o_orderkey, list_sort(forms) AS forms, list_contains(forms, '#' || round_even((o_orderkey % 12)::DOUBLE, 2)) AS hit, list_bool_or(list_transform(forms, lambda x: NOT starts_with(x, '#') AND (contains(x, ' b') OR contains(x, 'b ')))) AS says_b FROM f""")
def answer_forms(t: Tables) -> DataFrame:
    """Two lines a reply, each with a phrase that an answer follows, an equation, or nothing of the kind."""
    key = _text("o_orderkey")
    k = lambda n: (_c("o_orderkey") % n).cast("string")
    say = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    lines = [say("so the ", key, " final result is ", k(40), ".5"), say("Thus x = ", k(12)), say("Could be ", _c("o_orderpriority"), "."), say(key, " it stays"), "The answer IS B", "is :", say("y = 3 so 1 = ", k(9), "\t")]
    s = say(_pick("o_orderkey", "first", lines), "\n", _pick("o_orderkey", "second", lines), _pick("o_orderkey", "end", ["", " \n", "."]))
    forms = t.spread("orders", "o_orderkey", "o_orderpriority").select("o_orderkey", parsers.open_answer(s).alias("forms"))
    sure = lambda g: F.coalesce(parsers.open_match(_c("forms"), F.array(g)), F.lit(False))
    return forms.select("o_orderkey", F.sort_array("forms").alias("forms"), sure(k(12)).alias("hit"), sure(F.lit("B")).alias("says_b"))


_VQA = ["'The two ' || upper(p_name) || '!'", "'dont ' || p_name || '.'", "'a ' || p_name || ' 1,000'", "p_type || '/' || p_name || chr(10)", "'An apple''s ' || p_size || '.5 (' || p_name || ')'", "p_name || ' - ten;' || p_type", "'...' || p_name || '?'", "'Isnt it  THE youre ' || p_size"]


def _vqa_sql() -> str:
    plain = "replace(replace(replace(lower(s), ',', ''), '?', ''), '''s', ' ''s')"
    marks = "t"
    for m in parsers.MARKS:
        q = m.replace("'", "''")
        marks = f"replace({marks}, '{q}', CASE WHEN contains(t, '{q} ') OR contains(t, ' {q}') THEN '' ELSE ' ' END)"
    stops = "m"
    for _ in range(3):
        stops = f"regexp_replace({stops}, '\\.(\\D|$)', '\\1', 'g')"
    table = lambda d: "map {" + ", ".join(f"'{k.replace(chr(39), chr(39) * 2)}': '{v.replace(chr(39), chr(39) * 2)}'" for k, v in d.items()) + "}"
    return f"""WITH a AS (SELECT p_partkey, {_sql_pick('p_partkey', 'vqa', _VQA)} AS s FROM part), b AS (SELECT p_partkey, trim(translate(trim({plain}), chr(10) || chr(9), '  ')) AS t FROM a), c AS (SELECT p_partkey, {marks} AS m FROM b),
d AS (SELECT p_partkey, list_filter(string_split_regex({stops}, '\\s+'), lambda w: w <> '') AS words FROM c), n AS (SELECT {table(parsers.NUMBERS)} AS numbers, {table(parsers.CONTRACTIONS)} AS short)
SELECT p_partkey, coalesce(array_to_string(list_transform(list_filter(list_transform(words, lambda w: coalesce(numbers[w], w)), lambda w: w NOT IN ('a', 'an', 'the')), lambda w: coalesce(short[w], w)), ' '), '') AS norm FROM d, n"""


@query(_vqa_sql())
def evalai_answers(t: Tables) -> DataFrame:
    say = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    name, kind, size = _c("p_name"), _c("p_type"), _text("p_size")
    s = _pick("p_partkey", "vqa", [say("The two ", F.upper(name), "!"), say("dont ", name, "."), say("a ", name, " 1,000"), say(kind, "/", name, "\n"), say("An apple's ", size, ".5 (", name, ")"), say(name, " - ten;", kind), say("...", name, "?"), say("Isnt it  THE youre ", size)])
    return t.spread("part", "p_partkey", "p_name", "p_type", "p_size").select("p_partkey", parsers.evalai_answer(s).alias("norm"))


_SAYINGS = ["'room ' || p_size || ' ' || p_name", "p_name || ' Seven-rooms'", "'the ' || q || ' ' || p_type", "'yes'", "'No'", "p_name", "upper(q) || ' twentyfold'", "'TRUE'", "'half-' || p_name", "''"]


@query(f"""WITH q AS (SELECT [{', '.join(f"'{w}'" for w in parsers.QUANTITY_WORDS)}] AS quantities, [{', '.join(f"'{w}'" for w in parsers.COUNT_WORDS)}] AS counts), p AS (SELECT p_partkey, p_name, p_type, p_size, quantities[1 + p_size % len(quantities)] AS q, quantities, counts FROM part, q),
t AS (SELECT *, {_sql_pick('p_partkey', 'sayings', _SAYINGS)} AS s FROM p), w AS (SELECT *, regexp_extract_all(s, '[A-Za-z0-9_]+') AS words FROM t)
SELECT p_partkey, regexp_matches(s, '\\d') AS digit, regexp_matches(s, '\\d') OR list_has_any(list_transform(words, lambda x: lower(x)), counts) AS count_word, list_has_any(words, quantities) AS quantity, s IN ('Yes', 'No', 'True', 'False', 'yes', 'no', 'true', 'false', 'YES', 'NO', 'TRUE', 'FALSE') AS bool_word FROM w""")
def text_predicates(t: Tables) -> DataFrame:
    words = F.array(*[F.lit(w) for w in parsers.QUANTITY_WORDS])
    q = F.get(words, _c("p_size") % len(parsers.QUANTITY_WORDS))
    say = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    s = _pick("p_partkey", "sayings", [say("room ", _text("p_size"), " ", _c("p_name")), say(_c("p_name"), " Seven-rooms"), say("the ", q, " ", _c("p_type")), "yes", "No", _c("p_name"), say(F.upper(q), " twentyfold"), "TRUE", say("half-", _c("p_name")), ""])
    p = t.part.select("p_partkey", s.alias("s"))
    return p.select("p_partkey", parsers.has_digit(_c("s")).alias("digit"), parsers.has_number_word(_c("s")).alias("count_word"), parsers.has_quantity_word(_c("s")).alias("quantity"), parsers.is_bool_word(_c("s")).alias("bool_word"))


# --- judges

_N = "(1 + o_orderkey % 5)"
_VERDICTS = [
    f"'Well: {{\"why\": \"' || o_orderpriority || '\", \"quality_score\": ' || {_N} || '}} end 4/5'", f"'Quality_Score: ' || {_N} || ' of 5'", f"'it gets ' || {_N} || ' / 5 today'", f"{_N} || ' out of 5'", f"'I give it a ' || {_N} || '.'",
    "'no score 17'", f"'{{\"quality_score\": \"' || {_N} || 'd\"}}'", f"'{{\"quality_score\": ' || {_N} || '.0, }} quality score ' || {_N}",
]


@query(f"""WITH t AS (SELECT o_orderkey, {_sql_pick('o_orderkey', 'verdict', _VERDICTS)} AS s FROM orders), b AS (SELECT *, regexp_extract(s, '\\{{[^{{}}]*quality_score[^{{}}]*\\}}', 0) AS block FROM t)
SELECT o_orderkey, coalesce(TRY_CAST(CASE WHEN json_valid(block) THEN block ->> '$.quality_score' END AS DOUBLE)::INTEGER, nullif(regexp_extract(s, '(?is)quality[_\\s]*score\\s*[:：]?\\s*([1-5])', 1), '')::INTEGER, nullif(regexp_extract(s, '(?is)([1-5])\\s*/\\s*5', 1), '')::INTEGER,
 nullif(regexp_extract(s, '(?is)([1-5])\\s+out\\s+of\\s+5', 1), '')::INTEGER, nullif(regexp_extract(s, '\\b([1-5])\\b', 1), '')::INTEGER) AS score FROM b""")
def judged_scores(t: Tables) -> DataFrame:
    n, key = (1 + _c("o_orderkey") % 5).cast("string"), _c("o_orderpriority")
    say = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    s = _pick("o_orderkey", "verdict", [
        say('Well: {"why": "', key, '", "quality_score": ', n, "} end 4/5"), say("Quality_Score: ", n, " of 5"), say("it gets ", n, " / 5 today"), say(n, " out of 5"), say("I give it a ", n, "."),
        "no score 17", say('{"quality_score": "', n, 'd"}'), say('{"quality_score": ', n, ".0, } quality score ", n),
    ])
    return t.orders.select("o_orderkey", parsers.judged_score(s, "quality_score").alias("score"))


_REASONS = ["p_name", "'it has a } in ' || p_name", "'say \\\"' || p_name || '\\\" {'", "'{' || p_name", "''"]
_DUALS = [
    "'Thinking: ' || p_type || ' {\"instruction_score\": ' || a || ', \"instruction_reasoning\": \"' || why || '\", \"knowledge_score\": {\"x\": 1}} and {\"instruction_score\": 9}'",
    "'{\"knowledge_score\": \"' || a || '\", \"knowledge_reasoning\": \"' || why || '\", \"instruction_score\": null}'", "'Instruction score: ' || a || ' \"knowledge_reasoning\": \"because ' || p_name || '\"'", "'open { ' || p_name || ' knowledge_score: ' || a", "'none'",
]


@query(f"""WITH RECURSIVE w AS (SELECT p_partkey, p_name, p_type, 1 + p_size % 5 AS a, {_sql_pick('p_partkey', 'why', _REASONS)} AS why FROM part), t AS (SELECT p_partkey, p_name, a, {_sql_pick('p_partkey', 'dual', _DUALS)} AS s FROM w),
f AS (SELECT p_partkey, 0 AS i, 0 AS depth, -1 AS first, -1 AS last, false AS quoted, false AS escaped, s FROM t UNION ALL
 SELECT p_partkey, i + 1, CASE WHEN quoted THEN depth WHEN c = '{{' THEN depth + 1 WHEN c = '}}' AND depth > 0 THEN depth - 1 ELSE depth END, CASE WHEN NOT quoted AND c = '{{' AND depth = 0 THEN i ELSE first END, CASE WHEN NOT quoted AND c = '}}' AND depth = 1 THEN i ELSE last END,
 CASE WHEN c = '"' AND depth > 0 AND NOT escaped THEN NOT quoted ELSE quoted END, quoted AND NOT escaped AND c = '\\', s FROM (SELECT *, s[i + 1] AS c FROM f WHERE i < length(s) AND last < 0)),
e AS (SELECT p_partkey, s, CASE WHEN last >= 0 THEN s[first + 1:last + 1] END AS block FROM f WHERE last >= 0 OR i = length(s)), j AS (SELECT *, CASE WHEN json_valid(s) THEN s WHEN json_valid(block) THEN block END AS o FROM e)
SELECT p_partkey, block, CASE WHEN o IS NULL THEN nullif(regexp_extract(s, '(?i)"?instruction[_\\s]*score"?\\s*:\\s*([1-5])', 1), '')::INTEGER WHEN NOT json_exists(o, '$.instruction_score') THEN 0 ELSE TRY_CAST(o ->> '$.instruction_score' AS INTEGER) END AS instruction_score,
 CASE WHEN o IS NULL THEN nullif(regexp_extract(s, '(?i)"?knowledge[_\\s]*score"?\\s*:\\s*([1-5])', 1), '')::INTEGER WHEN NOT json_exists(o, '$.knowledge_score') THEN 0 ELSE TRY_CAST(o ->> '$.knowledge_score' AS INTEGER) END AS knowledge_score,
 o ->> '$.instruction_reasoning' AS instruction_reasoning, CASE WHEN o IS NULL THEN nullif(regexp_extract(s, '"knowledge_reasoning": "([^"]*)"', 1), '') ELSE o ->> '$.knowledge_reasoning' END AS knowledge_reasoning FROM j""")
def dual_judged_scores(t: Tables) -> DataFrame:
    """Objects in running text whose quoted reasons hold braces and quotes; the SQL scans for the balanced one character by character."""
    say = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    a, name = (1 + _c("p_size") % 5).cast("string"), _c("p_name")
    why = _pick("p_partkey", "why", [name, say("it has a } in ", name), say('say \\"', name, '\\" {'), say("{", name), ""])
    s = _pick("p_partkey", "dual", [
        say("Thinking: ", _c("p_type"), ' {"instruction_score": ', a, ', "instruction_reasoning": "', why, '", "knowledge_score": {"x": 1}} and {"instruction_score": 9}'),
        say('{"knowledge_score": "', a, '", "knowledge_reasoning": "', why, '", "instruction_score": null}'), say("Instruction score: ", a, ' "knowledge_reasoning": "because ', name, '"'), say("open { ", name, " knowledge_score: ", a), "none",
    ])
    return t.spread("part", "p_partkey", "p_name", "p_type", "p_size").select("p_partkey", s.alias("s")).select("p_partkey", judges.balanced_object(_c("s")).alias("block"), judges.dual_scores(_c("s")).alias("d")).select("p_partkey", "block", "d.*")


_A, _B = "(o_orderkey % 10)", "(o_orderkey % 7)"
_VIE = [
    f"'||V^=^V||' || chr(10) || '{{\"score\": [' || {_A} || ', ' || {_B} || '], \"reasoning\": \"y\"}}||V^=^V|| {{'", f"'so {{\"score\": ' || {_A} || ', \"r\": \"it is \"very\" good\"}} ok'", f"'{{score: [' || {_A} || ', ' || {_B} || ',],}}'", f"'I rate [' || {_A} || ', ' || {_B} || ']'",
    f"' ' || {_A} || chr(10)", f"{_A} || 'd'", f"'{{\"score\": \"' || {_A} || '\"}}'", "'{\"other\": 1}'", f"'{{\"score\": [' || {_A} || ', ' || {_B}",
]


@query(f"""WITH t AS (SELECT o_orderkey, {_sql_hash('o_orderkey', 'vie', len(_VIE))} AS k, {_A}::DOUBLE AS a, {_B}::DOUBLE AS b, {_sql_pick('o_orderkey', 'vie', _VIE)} AS s FROM orders),
r AS (SELECT *, replace(CASE WHEN len(string_split(s, '||V^=^V||')) = 3 THEN string_split(s, '||V^=^V||')[2] WHEN contains(s, '{{') AND contains(s, '}}') THEN regexp_extract(s, '(?s)\\{{.*\\}}', 0) END, chr(10), '') AS body FROM t),
x AS (SELECT *, regexp_replace(regexp_replace(replace(replace(body, 'is "very', 'is \\"very'), 'very" good', 'very\\" good'), ',(\\s*[}}\\]])', '\\1', 'g'), '([{{,]\\s*)([A-Za-z_]\\w*)(\\s*:)', '\\1"\\2"\\3', 'g') AS fixed FROM r),
j AS (SELECT *, CASE WHEN json_valid(body) THEN body WHEN json_valid(fixed) THEN fixed END AS o FROM x)
SELECT o_orderkey, CASE WHEN body IS NOT NULL THEN CASE WHEN json_type(o, '$.score') = 'ARRAY' THEN CAST(json_extract(o, '$.score') AS DOUBLE[]) WHEN o ->> '$.score' IS NOT NULL THEN [TRY_CAST(o ->> '$.score' AS DOUBLE)] END
 WHEN regexp_matches(s, '\\[\\d+, ?\\d+\\]') THEN CAST(regexp_extract(s, '\\[\\d+, ?\\d+\\]', 0)::JSON AS DOUBLE[]) WHEN regexp_full_match({_BARE.format('s')}, '\\d|10') THEN [{_BARE.format('s')}::DOUBLE] END AS scores FROM j""")
def repaired_score_lists(t: Tables) -> DataFrame:
    """Score lists between delimiters, in broken JSON, in brackets, as bare numbers."""
    say = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    a, b = ((_c("o_orderkey") % n).cast("string") for n in (10, 7))
    s = _pick("o_orderkey", "vie", [
        say('||V^=^V||\n{"score": [', a, ", ", b, '], "reasoning": "y"}||V^=^V|| {'), say('so {"score": ', a, ', "r": "it is "very" good"} ok'), say("{score: [", a, ", ", b, ",],}"), say("I rate [", a, ", ", b, "]"),
        say(" ", a, "\n"), say(a, "d"), say('{"score": "', a, '"}'), '{"other": 1}', say('{"score": [', a, ", ", b),
    ])
    return t.orders.select("o_orderkey", judges.viescore_list(s).alias("scores"))


_NAMED = [f"'sharpness: ' || {_A}", "'no score here'", f"' colour :  ' || {_B} || ' '", f"'depth: ' || {_A} || 'd'", f"'a: b: ' || {_B}", "''", f"'noise: ' || {_A} || '.5'"]


@query(f"""WITH l AS (SELECT o_orderkey, j, [{', '.join(_NAMED)}][1 + ('0x' || left(md5(o_orderkey || ':line' || j), 8))::BIGINT % {len(_NAMED)}] AS line FROM orders, range(0, 4) r(j)), v AS (SELECT o_orderkey, {_BARE.format("string_split(line, ':')[-1]")} AS v FROM l)
SELECT o_orderkey, round(avg(CASE WHEN regexp_full_match(v, '\\d+') THEN v::INTEGER END), 2) AS mean, [{_A}::DOUBLE, 4.0] AS listed, [{_A}::DOUBLE] AS bare FROM v GROUP BY o_orderkey""")
def named_and_listed_scores(t: Tables) -> DataFrame:
    """The mean of four lines, of which some are a name and a whole number; a list of scores between delimiters; a bare score."""
    say = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    a, b = ((_c("o_orderkey") % n).cast("string") for n in (10, 7))
    lines = [say("sharpness: ", a), "no score here", say(" colour :  ", b, " "), say("depth: ", a, "d"), say("a: b: ", b), "", say("noise: ", a, ".5")]
    text = F.concat_ws("\n", *[_pick("o_orderkey", f"line{j}", lines) for j in range(4)])
    listed = say('||V^=^V||{"score": [', a, ', 4], "reasoning": "y"}||V^=^V||')
    rows = t.spread("orders", "o_orderkey")
    return rows.select("o_orderkey", parsers.mean_of_named_ints(text).alias("mean"), judges.viescore_list(listed).alias("listed"), judges.viescore_list(a).alias("bare"))


# --- evaluators

_NORMAL = "trim(regexp_replace(regexp_replace(' ' || lower(x) || ' ', ' (a|an|the) ', ' ', 'g'), '[ ]+', ' ', 'g'))"


@query(f"""WITH p AS (SELECT p_size % 7 AS g, CASE WHEN p_partkey % 5 = 0 THEN 'the ' || p_name ELSE p_type || chr(10) END AS said, [p_name, p_type, upper(p_name), p_type, p_type || 'x', p_size::VARCHAR] AS answers, p_partkey % 5 = 0 AS named FROM part),
s AS (SELECT g, regexp_replace(said, '\\s+$', '') AS bare, said, answers, named FROM p),
r AS (SELECT g, (list_contains(list_transform(answers, lambda x: lower(x)), lower(bare)))::INTEGER AS exact, list_max(list_transform(answers, lambda x: 1 - levenshtein(lower(bare), lower(x)) / greatest(length(bare), length(x)))) AS far,
 len(list_filter(answers, lambda x: {_NORMAL} = {_NORMAL.replace('lower(x)', 'lower(bare)')})) AS m FROM s)
SELECT g, how, count(*) AS n, round(avg(CASE how WHEN 'exact' THEN exact WHEN 'anls' THEN CASE WHEN far < 0.5 THEN 0 ELSE far END ELSE (m * least(1, (m - 1) / 3) + (6 - m) * least(1, m / 3)) / 6 END), 6) AS score FROM r, unnest(['exact', 'anls', 'vqa']) t(how) GROUP BY ALL""")
def evaluator_means(t: Tables) -> DataFrame:
    """Three evaluators over predictions with an article or a line feed, by group."""
    said = F.when(_c("p_partkey") % 5 == 0, F.concat(F.lit("the "), "p_name")).otherwise(F.concat("p_type", F.lit("\n")))
    answers = F.array("p_name", "p_type", F.upper("p_name"), "p_type", F.concat("p_type", F.lit("x")), _text("p_size"))
    rows = t.spread("part", "p_partkey", "p_size", "p_name", "p_type").select((_c("p_size") % 7).alias("g"), said.alias("said"), answers.alias("answers"))
    parts = [metrics.evaluated(rows, how, "said", "answers", ["g"]).select("g", F.lit(how).alias("how"), "n", F.round("score", 6).alias("score")) for how in ("exact", "anls", "vqa")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
