"""Personal data in texts replaced by keyed surrogates of the same type.

Entities are found by one pattern. Every distinct entity of the corpus (type and canonical form, so that spellings of one
number or address are one entity) gets one surrogate, a keyed digest rendered in its shape: letters stay letters of the same
script and case, digits stay digits, separators, country codes, issuers' first digits, check digits, mail domains' endings and
the gender of titled names are kept. Surrogates that meet another surrogate or any real entity are drawn again, so distinct
entities stay distinct and equal ones stay equal across all documents.

Everything is DataFrame operations; only texts with a digit, an at sign, a title or the beginning of a secret are looked at closely or moved.
"""
from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, functions as F

from wattlens.llm.arrow_text import apart
from wattlens.plans.joins import lookup_join
from wattlens.plans.staging import stage

KEY_SETTING = "spark.wattlens.surrogateKey"
HELPERS = ["_doc", "_found", "_map", "_between"]
#: fixed values: titles that tell the gender of a name
MALE, FEMALE = "Mr|Herr|Monsieur|Señor|Sir", "Mrs|Ms|Miss|Frau|Madame|Señora|Madam"
SECRET_WORDS = r"(?i:token|secret|password|passwd|api[_\-]?key|access[_\-]?key|private[_\-]?key|bearer)"
_END = r"(?![\p{L}\p{N}])"
_START = r"(?<![\p{L}\p{N}])"
_SSN = r"(?<![\p{L}\p{N}\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}\-])"
# digits that a card may have between separators: no beginning of another number, no part of a word or a decimal number
_GROUP = rf"(?!{_SSN}|[0-9]{{3}}[.\-][0-9]{{3}}[ .\-][0-9]{{4}}{_END})[0-9]{{1,19}}+(?![\p{{L}}\p{{N}}]|\.[0-9])"
TYPES = {  # in the order in which they are tried at a place; each begins with what rules most places out at little cost
    "email": r"(?<![\p{L}\p{M}\p{N}._%+\-])[\p{L}\p{M}\p{N}._%+\-]++@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62}[A-Za-z0-9])?){1,8}",
    "secret": r"(?<=[\"'=:\s])(?=[A-Za-z0-9+/_\-.]{12})(?<=" + SECRET_WORDS + r"[\"']?\s{0,3}[=:]\s{0,3}[\"']?)"
              r"(?=[+/_\-.]*[A-Za-z0-9])[A-Za-z0-9+/_\-.]{12,}(?<!\.)={0,2}"
              r"|(?=[Ags])" + _START + r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_\-]{20,})" + _END,
    "ip": r"(?=[0-9])(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\p{L}\p{N}]|\.[0-9])",
    "ssn": r"(?=[0-9])" + _SSN,
    "phone": r"(?=[+(0-9])(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.\-])[0-9]{3}[ .\-][0-9]{4}" + _END
             + r"|(?=\+)(?<![\p{L}\p{N}+])\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,5}" + _END,
    # a run of digits that may hold cards
    "card": rf"(?=[0-9])(?<![\p{{L}}\p{{N}}.\-])(?=(?={_GROUP})[0-9](?:[0-9]|[ \-](?={_GROUP})[0-9]){{12}}){_GROUP}(?:[ \-]{_GROUP})*+",
    "name": r"(?=[FHMS])" + _START + rf"(?:{MALE}|{FEMALE})\.?\s{{1,3}}\p{{Lu}}\p{{L}}{{1,30}}(?: \p{{Lu}}\p{{L}}{{1,30}})?" + _END,
}
TITLED = rf"\A((?:{MALE}|{FEMALE})\.?\s{{1,3}})(.*)\z"
PATTERN = "|".join(f"({p})" if t == "card" else f"(?:{p})" for t, p in TYPES.items())  # its one group: a run of digits
# implied by every alternative of PATTERN
GATE = (rf"[0-9@]|(?=[FHMS]){_START}(?:{MALE}|{FEMALE})\.?\s|(?=[Ags]){_START}(?:AKIA|gh[pousr]_|sk-)"
        rf"|(?=[AaBbPpSsTt]){SECRET_WORDS}[\"']?\s{{0,3}}[=:]")
ISSUERS = r"\A(?:(?i:AKIA)|gh[pousr]_|sk-)"
_PAIRS = 128
ROUNDS = 8  # attempts in one length
LATIN = "abcdefghijklmnopqrstuvwxyz"  # also for letters of scripts that are not listed
SCRIPTS = {"Latin": LATIN, "Cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "Greek": "αβγδεζηθικλμνξοπρστυφχψω",
           "Armenian": "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցփքօֆ", "Georgian": "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ",
           "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת", "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
           "Devanagari": "अआइईउऊएऐओऔकखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह", "Thai": "กขคงจฉชซญฐณดตถทธนบปผฝพฟภมยรลวศสหอฮ",
           "Hiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ",
           "Katakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ",
           "Hangul": "가나다라마바사아자차카타파하고노도로모보소오조초코토포호구누두루무부수우주추쿠투푸후",
           "Han": "一丁七三上下中丸主久乙九二五人今介仁元光全公六兵典冬千升南友口古司合吉同名向周和品四回土在地坂城夏夕大天"}
NAME_PARTS = ["bar", "del", "mon", "tal", "rin", "vos", "ker", "lan"]
MALE_NAMES = ["Adrian", "Bruno", "Carl", "David", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karel", "Leon",
              "Martin", "Niklas", "Oscar", "Paul"]
FEMALE_NAMES = ["Anna", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irma", "Julia", "Karla", "Laura",
                "Marta", "Nora", "Olga", "Paula"]


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn_sum(digits: Column, doubled_first: int) -> Column:
    """Sum of the digits from the right, every second one doubled, from place `doubled_first` (0: the last) on."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda x: x.cast("int"))
    turned = F.transform(values, lambda v, i: F.when(i % 2 == doubled_first, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v))
    return F.aggregate(turned, F.lit(0), lambda s, v: s + v)


def kind_of(match: Column) -> Column:
    """Type of a match of PATTERN that is no run of digits."""
    whole = {t: match.rlike(rf"\A(?:{p})\z") for t, p in TYPES.items() if t in ("email", "ip", "ssn", "phone")}
    name = match.rlike(rf"\A(?:{MALE}|{FEMALE})\.?\s")
    out = F.when(whole["email"], "email")
    for t in ("ip", "ssn", "phone"):
        out = out.when(whole[t], t)
    return out.when(name, "name").otherwise("secret")


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


CARD_LENGTHS = [16, 15, 14, 13, 19, 18, 17]  # of cards that overlap, the one of the earlier length
_WINDOW = "struct<rank:bigint,first:int,size:int>"


def card_pieces(run: Column) -> Column:
    """A run of digits cut into structs of raw and kind: the cards in it, and what is between them (kind null).

    A card is one or more whole groups of the run with 13 to 19 digits in all, not all the same, and a valid check digit.
    """
    def windows(groups: Column) -> Column:
        def best(_: Column, i: Column) -> Column:
            sizes = F.sequence(F.lit(1), F.least(F.lit(19), F.size(groups) - i))
            tried = F.transform(sizes, lambda k: F.struct(k.alias("size"), _digits(F.array_join(F.slice(groups, i + 1, k), "")).alias("digits")))
            fit = F.filter(F.filter(tried, lambda w: F.length(w["digits"]).between(13, 19)), lambda w: (
                _luhn_sum(w["digits"], 1) % 10 == 0) & ~w["digits"].rlike(r"\A(.)\1*\z"))
            lengths = F.array(*map(F.lit, CARD_LENGTHS))
            return F.array_min(F.transform(fit, lambda w: F.struct(F.array_position(lengths, F.length(w["digits"])).alias("rank"),
                                                                   i.alias("first"), w["size"].alias("size"))))

        start = F.struct(F.array().cast(f"array<{_WINDOW}>").alias("done"), F.lit(None).cast(_WINDOW).alias("last"))
        return F.aggregate(F.filter(F.transform(groups, best), lambda w: w.isNotNull()), start, lambda s, w: F
                           .when(s["last"].isNull(), F.struct(s["done"].alias("done"), w.alias("last")))
                           .when(w["first"] >= s["last"]["first"] + s["last"]["size"],
                                 F.struct(F.concat(s["done"], F.array(s["last"])).alias("done"), w.alias("last")))
                           .when(w["rank"] < s["last"]["rank"], F.struct(s["done"].alias("done"), w.alias("last"))).otherwise(s),
                           lambda s: F.when(s["last"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["last"]))))

    def cut(groups: Column, chosen: Column) -> Column:
        def piece(first: Column, size: Column, kind: str | None) -> Column:
            return F.struct(F.array_join(F.slice(groups, first + 1, size), "").alias("raw"), F.lit(kind).cast("string").alias("kind"))

        def end(j: Column) -> Column:  # of the card before the j-th
            return F.when(j > 0, F.get(chosen, j - 1)["first"] + F.get(chosen, j - 1)["size"]).otherwise(0)

        cards = F.flatten(F.transform(chosen, lambda w, j: F.array(piece(end(j), w["first"] - end(j), None),
                                                                   piece(w["first"], w["size"], "card"))))
        return F.concat(cards, F.array(piece(end(F.size(chosen)), F.size(groups) - end(F.size(chosen)), None)))

    groups_ = F.regexp_extract_all(run, F.lit(r"[0-9]+[ \-]?"), F.lit(0))
    return _let(groups_, lambda groups: _let(windows(groups), lambda chosen: cut(groups, chosen)))


def canonical_of(kind: Column, match: Column) -> Column:
    """One form for all spellings: lower case, digits without separators, phones without the country code."""
    digits = _digits(match)
    hexa = match.rlike(r"\A[0-9A-Fa-f]+\z")
    return (F.when(kind == "email", F.lower(match)).when(kind == "phone", F.when(F.length(digits) > 10, F.right(digits, F.lit(10)))
            .otherwise(digits)).when(kind.isin("card", "ssn"), digits)
            .when(kind == "name", F.concat(F.when(match.rlike(rf"\A(?:{FEMALE})\b"), "f:").otherwise("m:"),
                                           F.lower(F.regexp_extract(match, TITLED, 2)))).when((kind == "secret") & hexa, F.lower(match)).otherwise(match))


def entities(text: Column) -> Column:
    """The matches in a text in order: structs of raw, kind (null: stays as it is), canonical, and the number of the match that
    ends with it (null: the next one is of the same match)."""
    def pieces(matches: Column) -> Column:
        digits = F.exists(matches, lambda m: m.rlike(r"\A[0-9]++(?:[ \-][0-9]++)*+\z"))
        runs = F.when(digits, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(1))).otherwise(F.transform(matches, lambda m: F.lit("")))
        cut = F.zip_with(matches, runs, lambda m, run: F.when(run != "", card_pieces(run)).otherwise(
            F.array(F.struct(m.alias("raw"), kind_of(m).alias("kind")))))
        return F.flatten(F.transform(cut, lambda parts, i: F.transform(parts, lambda e, j: F.struct(
            e["raw"].alias("raw"), e["kind"].alias("kind"), canonical_of(e["kind"], e["raw"]).alias("canonical"),
            F.when(j == F.size(parts) - 1, i).alias("match")))))

    return _let(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), pieces)


def _value(stream: Column, index: Column, below: Column | int) -> Column:
    """Number below `below` (at most 256) from the digest's pair of hex digits at an index."""
    at = F.substring(stream, F.pmod(index, F.lit(_PAIRS)) * 2 + 1, F.lit(2))
    return F.conv(at, 16, 10).cast("int") % below


def _pick(letters: str, number: Column) -> Column:
    return F.substring(F.lit(letters), number + 1, F.lit(1))


def shaped(text: Column, stream: Column, secret: Column) -> Column:
    """Keyed characters in place of a text's: of the same class, case and script; signs stay. A secret in hexadecimal stays so."""
    hexa = secret & text.rlike(r"\A[0-9a-f]+\z") & text.rlike("[a-f]")

    def drawn(c: Column, i: Column) -> Column:
        out = (F.when(hexa, _pick("0123456789abcdef", _value(stream, i, 16)))
               .when(c.rlike("[0-9]"), _value(stream, i, 10).cast("string"))
               .when(c.rlike("[a-z]"), _pick(LATIN, _value(stream, i, 26)))
               .when(c.rlike("[A-Z]"), F.upper(_pick(LATIN, _value(stream, i, 26))))
               .when(~c.rlike(r"[\p{L}\p{M}\p{N}]"), c))
        for script, letters in SCRIPTS.items():
            out = out.when(c.rlike(rf"\p{{Is{script}}}"), _pick(letters, _value(stream, i, len(letters))))
        return out.otherwise(_pick(LATIN, _value(stream, i, 26)))

    return F.array_join(F.transform(F.split(text, ""), drawn), "")


def with_surrogates(entities_: DataFrame, attempt: int, key: str) -> DataFrame:
    """Add the keyed `surrogate` of each (kind, canonical), a canonical form of the same type itself.

    A canonical form has one or two parts that are shaped: a mail's local part and domain, a name's first and family name,
    otherwise all of it. The second part's digest depends on that part alone, so people of one domain stay together
    and a family keeps its surrogate whoever bears it. Every ROUNDS attempts the surrogate gets a character longer, so that
    there always is a free one, however few have the entity's shape.
    """
    longer = attempt // ROUNDS
    kind, canonical = F.col("kind"), F.col("canonical")

    def digest(*parts) -> Column:
        return F.concat(*[F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit(n), *parts), 512) for n in ("0", "1")])

    whole_name = F.substring_index(canonical, ":", -1)
    domain = F.substring_index(canonical, "@", -1)
    main = F.when(kind == "email", F.substring_index(canonical, "@", 1)).when(
        kind == "name", F.substring_index(whole_name, " ", 1)).otherwise(canonical)
    second = F.when(kind == "email", F.regexp_replace(domain, r"\.[^.]*\z", "")).when(
        kind == "name", F.substring_index(whole_name, " ", -1)).otherwise("")
    parts = entities_.withColumns({"_main": main, "_second": second, "_stream": digest(F.lit(str(attempt)), kind, canonical)})
    again = F.when(kind == "name", F.lit(str(attempt))).otherwise("")
    parts = parts.withColumn("_stream2", digest(again, kind, F.col("_second")))
    grown = F.when(kind == "name", F.col("_main")).otherwise(F.concat("_main", F.lit("0" * longer)))
    grown2 = F.when(kind == "name", F.concat("_second", F.repeat(F.left("_second", F.lit(1)), F.lit(longer)))).otherwise(F.col("_second"))
    drawn = shaped(grown, F.col("_stream"), kind == "secret")
    issuer = F.regexp_extract(canonical, ISSUERS, 0)  # tells what kind of secret it is, so it stays
    drawn = F.when(kind == "secret", F.concat(issuer, F.substring(drawn, F.length(issuer) + 1, F.length(drawn)))).otherwise(drawn)
    parts = parts.withColumns({"_a": drawn, "_b": shaped(grown2, F.col("_stream2"), F.lit(False))})
    stream, a, b = F.col("_stream"), F.col("_a"), F.col("_b")

    def number(i: int, below: int) -> Column:
        return _value(stream, F.lit(i), below)

    def choice(values: list[str], i: int) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), number(i, len(values)) + 1)

    email = F.concat(a, F.lit("@"), b, F.lit("."), F.substring_index(domain, ".", -1))
    phone = F.concat((number(0, 8) + 2).cast("string"), F.substring(a, F.lit(2), F.length(a)))
    without_check = F.concat(F.left(canonical, F.lit(1)), F.substring(a, F.lit(2), F.length(a) - 2))
    card = F.concat(without_check, F.pmod(-_luhn_sum(without_check, 0), F.lit(10)).cast("string"))
    local = canonical.rlike(r"\A(10\.|127\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)")
    ip = F.concat_ws(".", F.when(local & F.lit(not longer), "10").otherwise((11 + number(0, 100)).cast("string")),
                     *[(1 + number(i, 254)).cast("string") for i in range(1, 3 + max(1, longer))])
    # first names are of the gender, and longer the more often they were drawn
    first = F.concat(F.when(canonical.startswith("f:"), choice(FEMALE_NAMES, 0)).otherwise(choice(MALE_NAMES, 0)),
                     *[choice(NAME_PARTS, i + 1) for i in range(attempt // 4)])
    first = F.when(canonical.rlike(r"[\p{L}&&[^\p{IsLatin}]]"), a).otherwise(F.lower(first))
    name = F.concat(F.left(canonical, F.lit(2)), F.when(canonical.contains(" "), F.concat(first, F.lit(" "))).otherwise(""), b)
    surrogate = (F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ip", ip)
                 .when(kind == "name", name).otherwise(a))
    return parts.withColumn("surrogate", surrogate).select("kind", "canonical", "surrogate")


def assign(found: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, surrogate) for every distinct entity; no surrogate is another's or a real entity of its type.

    Of entities that draw the same surrogate the smallest keeps it, the others draw again; so do those that draw a real entity
    or a surrogate that is taken. One round is the rule; rounds go on until all are settled, which later attempts' longer surrogates make sure of.
    """
    real = stage(found.select("kind", "canonical").distinct(), "entities")
    left, settled, attempt = real, None, 0
    while True:
        drawn = stage(with_surrogates(left, attempt, key), "drawn")
        first = drawn.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical"))
        taken = real.select("kind", F.col("canonical").alias("surrogate"))
        if settled is not None:
            taken = taken.unionByName(settled.select("kind", "surrogate"))
        good = stage(first.join(taken, ["kind", "surrogate"], "left_anti"), "settled")
        settled = good if settled is None else settled.unionByName(good)
        left = drawn.select("kind", "canonical").join(good, ["kind", "canonical"], "left_anti")
        attempt += 1
        if left.limit(1).count() == 0:
            return settled
        left = stage(left, "entities")


def rendered(raw: Column, kind: Column, canonical: Column, surrogate: Column) -> Column:
    """The surrogate in the spelling of the match: its separators, prefix, title and case. What it is longer follows at the end."""
    name = F.concat(F.regexp_extract(raw, TITLED, 1), F.initcap(F.substring_index(surrogate, ":", -1)))
    letters = F.array_join(F.zip_with(F.split(raw, ""), F.split(surrogate, ""), lambda a, b: F.when(
        (a == F.upper(a)) & (a != F.lower(a)), F.upper(b)).otherwise(b)), "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))
    placed = F.left(surrogate, F.length(canonical))
    digits = F.aggregate(F.reverse(F.split(raw, "")), start, lambda s, c: F.when(
        c.rlike("[0-9]") & (s["used"] < F.length(placed)),
        F.struct(F.concat(F.substring(placed, F.length(placed) - s["used"], F.lit(1)), s["out"]).alias("out"),
                 (s["used"] + 1).alias("used")))
        .otherwise(F.struct(F.concat(c, s["out"]).alias("out"), s["used"].alias("used"))), lambda s: s["out"])
    digits = F.concat(digits, F.substring(surrogate, F.length(canonical) + 1, F.length(surrogate)))
    return (F.when(surrogate.isNull(), raw).when(kind.isin("phone", "card", "ssn"), digits).when(kind == "ip", surrogate)
            .when(kind == "name", name).when(raw == F.upper(raw), F.upper(surrogate)).otherwise(letters))


def session_key(spark) -> str:
    """The session's secret key for surrogates; one that no other session has where none is set."""
    key = spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)
    spark.conf.set(KEY_SETTING, key)
    return key


def replace_entities(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """`docs` with all entities in the text column replaced, and `n_replaced`, how many.

    Texts without entities, null and empty texts stay as they are with 0. Digit strings that only look like card numbers (no
    valid check digit) stay; in a run of digits every row of whole groups is tried. Equal texts and repeated rows get equal results; other columns are kept whatever their names are, one called
    n_replaced is replaced. The same key gives the same surrogates for the same corpus, and who has not got it can't compute
    them; an empty table stays empty.
    """
    return apart(docs.drop("n_replaced"), HELPERS, lambda rows, moved: _replaced(rows, key, moved.get(text_col, text_col)))


def _replaced(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    gate = F.coalesce(text.rlike(GATE), F.lit(False))
    near = docs.filter(gate).withColumn("_doc", F.xxhash64(text_col)).withColumn("_found", entities(text))
    # the outer form: for the inner one the optimizer adds a filter that would look for the entities a second time
    found = near.select("_doc", F.explode_outer("_found").alias("e")).filter("e.kind is not null")
    found = stage(found.select("_doc", "e.kind", "e.canonical").distinct(), "occurrences")
    table = assign(found, key)
    pair = F.struct(F.concat_ws("\u0001", "kind", "canonical").alias("k"), F.col("surrogate").alias("v"))
    maps = (lookup_join(found, table, ["kind", "canonical"], spread=["_doc"], how="inner")
            .groupBy("_doc").agg(F.map_from_entries(F.collect_set(pair)).alias("_map")))
    hit = near.join(maps, "_doc", "left")
    between = F.split(text, PATTERN, -1)
    number = F.size("_found")

    def new_text(e: Column) -> Column:
        surrogate = F.when(e["kind"].isNotNull(), F.element_at("_map", F.concat_ws("\u0001", e["kind"], e["canonical"])))
        return F.concat(rendered(e["raw"], e["kind"], e["canonical"], surrogate), F.when(e["match"].isNotNull(), F.get(F.col("_between"), e["match"] + 1)).otherwise(""))

    written = hit.withColumn("_between", F.when(F.col("_map").isNotNull(), between)).withColumn(
        text_col, F.when(F.col("_map").isNotNull() & (number > 0), F.concat(
            F.element_at("_between", 1), F.array_join(F.transform("_found", new_text), ""))).otherwise(text))
    count = F.when(F.col("_map").isNotNull(), F.size(F.filter("_found", lambda e: e["kind"].isNotNull()))).otherwise(0)
    changed = written.withColumn("n_replaced", count.cast("long")).select(*docs.columns, "n_replaced")
    return changed.unionByName(docs.filter(~gate).withColumn("n_replaced", F.lit(0).cast("long")))


def op4_surrogate_pii(spark, sf_dir: str) -> DataFrame:
    return replace_entities(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), session_key(spark))
