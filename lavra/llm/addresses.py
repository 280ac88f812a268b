"""Problem 1: which address records denote the same location.

Each record is parsed into street (type, title, name), number and unit (kind, number, block), wherever the
parts were written; abbreviations are spelled out by locale dictionaries and the parts are put in one order.
Then keys are resolved from the top of the hierarchy down, each level with its rule for a missing part:

1. district: as written; else the one its postal code has elsewhere; else the one the street name has.
2. street within the district: a rare spelling that differs from a much better attested one by one slip inside a
   word, by gaps, or by left-out linking words, is that street; initials stand for the only street they fit.
   Two attested spellings are two streets, and numbers, letters and endings never slip (``is_slip``, ``_believed``).
   Streets of other types or titles are other streets; a missing type or title is any.
3. number: never corrected.
4. unit within the number: a missing block is the only one known for that unit; a missing unit is the only
   unit known at the number.

Records with equal keys are one location, so the joins are equalities and groups of equal records are never
compared with each other.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.contracts import require_columns
from lavra.functions.text import UNIT_NULL_TOKENS, fold_accents, strip
from lavra.operators.records import once
from lavra.session import materialize


@dataclass(frozen=True)
class Locale:
    """Words of one language's addresses, folded and in upper case."""

    types: dict[str, str] = field(default_factory=lambda: {
        "R": "RUA", "RUA": "RUA", "AV": "AVENIDA", "AVN": "AVENIDA", "AVE": "AVENIDA", "AVEN": "AVENIDA", "AVENIDA": "AVENIDA",
        "TV": "TRAVESSA", "TRAV": "TRAVESSA", "TR": "TRAVESSA", "TRAVESSA": "TRAVESSA", "AL": "ALAMEDA", "ALAM": "ALAMEDA", "ALAMEDA": "ALAMEDA",
        "ROD": "RODOVIA", "RODOVIA": "RODOVIA", "EST": "ESTRADA", "ESTR": "ESTRADA", "ESTRADA": "ESTRADA", "PC": "PRACA", "PCA": "PRACA",
        "PRACA": "PRACA", "BC": "BECO", "BCO": "BECO", "BECO": "BECO", "LGO": "LARGO", "LG": "LARGO", "LARGO": "LARGO", "VIA": "VIA",
        "ACESSO": "ACESSO", "PASSAGEM": "PASSAGEM", "PSG": "PASSAGEM", "LADEIRA": "LADEIRA", "LAD": "LADEIRA", "VIELA": "VIELA",
    })
    titles: dict[str, str] = field(default_factory=lambda: {
        "DR": "DOUTOR", "DRA": "DOUTORA", "ENG": "ENGENHEIRO", "ENGO": "ENGENHEIRO", "ENGA": "ENGENHEIRA", "PROF": "PROFESSOR", "PROFA": "PROFESSORA", "PE": "PADRE",
        "CEL": "CORONEL", "MAL": "MARECHAL", "GAL": "GENERAL", "GEN": "GENERAL", "CAP": "CAPITAO", "MAJ": "MAJOR", "TEN": "TENENTE", "SGT": "SARGENTO",
        "VER": "VEREADOR", "DEP": "DEPUTADO", "SEN": "SENADOR", "GOV": "GOVERNADOR", "PRES": "PRESIDENTE", "PREF": "PREFEITO", "DES": "DESEMBARGADOR",
        "STA": "SANTA", "STO": "SANTO", "COM": "COMENDADOR", "VISC": "VISCONDE", "MIN": "MINISTRO", "ALM": "ALMIRANTE", "BRIG": "BRIGADEIRO", "MONS": "MONSENHOR",
    })
    whole_titles: tuple[str, ...] = ("SAO", "DOM", "DONA", "FREI", "BARAO", "IRMA", "IRMAO")
    links: tuple[str, ...] = ("DE", "DA", "DO", "DAS", "DOS", "E")
    districts: dict[str, str] = field(default_factory=lambda: {
        "JD": "JARDIM", "JARD": "JARDIM", "PQ": "PARQUE", "PQE": "PARQUE", "PRQ": "PARQUE", "VL": "VILA", "V": "VILA", "CJ": "CONJUNTO", "CONJ": "CONJUNTO",
        "RES": "RESIDENCIAL", "CH": "CHACARA", "N": "NOVO", "NV": "NOVO", "AT": "ALTO", "STA": "SANTA", "STO": "SANTO", "S": "SAO",
    })
    flat: str = "APARTAMENTO|APARTO|APTO|APT|AP"
    room: str = r"CONJ\.? SALA|CONJUNTO|SALA|SL|S/|CJ"
    shop: str = "LOJA|LJ"
    any_unit: str = "UNIDADE|UNID|UN"
    block: str = "BLOCO|BL|TORRE"


PORTUGUESE = Locale()


def _known(words: dict[str, str], c: Column) -> Column:
    """What ``c`` stands for; null where it is neither an abbreviation nor a full word of ``words``."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), c)


def _lookup(words: dict[str, str], c: Column) -> Column:
    return F.coalesce(_known(words, c), c)


def _flat(c: Column) -> Column:
    """Folded, upper case, white space squeezed; null tokens are empty."""
    text = F.upper(fold_accents(F.regexp_replace(F.regexp_replace(strip(F.coalesce(c.cast("string"), F.lit(""))), "[ºª°]", ""), r"\s+", " ")))
    tokens = "|".join(re.escape(t.upper()) for t in UNIT_NULL_TOKENS if t)
    return F.regexp_replace(text, rf"\A(?:{tokens})\z", "")


def parse_addresses(records: DataFrame, locale: Locale = PORTUGUESE, id_col: str = "address_record_id", area: str = "cod_municipio") -> DataFrame:
    """``id, area, raw, raw2, type, title, name, number, unit, kind, block, district, postcode``: the parts of each record.

    ``name`` is an array of words without type, title and linking words; words with a hyphen are one. Parts that are nowhere
    written are null. The number is the first run of digits of its field, else of the street field after the name; what
    follows it is read for the unit. ``raw`` and ``raw2`` (128 bits) tell equal records.
    """
    fields = ["logradouro", "n_endereco", "complemento_endereco", "bairro", "cep"]
    require_columns(records, [id_col, area, *fields], "address records")
    written = [F.coalesce(F.col(f).cast("string"), F.lit("\x00")) for f in fields]
    marker = r"^(.*?)[\s,./-]*(?:\b(?:N|NO|NR|NUM|NUMERO)\b[.:]?\s*)?(\d[\d.]*)(.*)$"
    t = records.select(
        F.col(id_col).alias("id"), F.col(area).alias("area"), F.xxhash64(*written).alias("raw"), F.xxhash64(F.lit(1), *written).alias("raw2"), *fields,
    )
    t = once(t, **{f"_{f}": _flat(F.col(f)) for f in fields[:4]}, _cep=F.regexp_replace(F.coalesce("cep", F.lit("")), "[^0-9]", "")).drop(*fields)
    own = F.regexp_extract("_n_endereco", r"^\D*?(\d+)", 1)
    # One match gives all three parts: before the number, the number, and what follows.
    t = once(t, _own=own, _cut=F.split(F.regexp_replace("_logradouro", marker, "$1\u0001$2\u0001$3"), "\u0001"))
    inline, (head, digits, tail) = F.size("_cut") == 3, [F.try_element_at("_cut", F.lit(i)) for i in (1, 2, 3)]
    # The street field holds the number only where the number field has none; a number in the street's name stays.
    take = (F.col("_own") == "") & inline
    same = (F.col("_own") != "") & inline & (F.regexp_replace(digits, r"^0+|\..*$", "") == F.regexp_replace("_own", "^0+", ""))
    cut = take | same
    t = once(
        t,
        _street=F.when(cut, head).otherwise(F.col("_logradouro")),
        _digits=F.when(take, F.regexp_extract(digits, r"^(\d+)", 1)).otherwise(F.col("_own")),
        _rest=F.concat_ws(
            " ; ",
            F.when(cut, tail),
            F.regexp_replace(F.regexp_replace("_n_endereco", r"^\D*?\d+(?:\.0+(?!\d))?", ""), r"^\s*[-/,]\s*", " "),
            F.col("_complemento_endereco"),
        ),
    )
    # "NAME, TYPE TITLE" is turned round; then points and other marks go.
    turned = F.regexp_replace("_street", r"^([^,]+),\s*([^,]+)$", "$2 $1")
    last = F.split(F.trim(F.regexp_replace(F.regexp_replace(turned, r"'|(?<=[A-Z])-(?=[A-Z])", ""), r"[^A-Z0-9]+", " ")), " ")
    block_at = rf"(?:^|[^A-Z])(?:{locale.block})[\s.]*(?:N[O.]?\s*)?([A-Z]|\d+)(?![A-Z0-9])"
    t = once(t, _words=F.filter(last, lambda w: w != ""), _block=F.regexp_extract("_rest", block_at, 1), _rest2=F.regexp_replace("_rest", block_at, " ; "))
    first = F.try_element_at("_words", F.lit(1))
    kind_word = _known(locale.types, first)
    # A name of one word that looks like a type is a name.
    typed = kind_word.isNotNull() & (F.size("_words") > 1)
    t = t.withColumn("type", F.when(typed, kind_word))
    t = t.withColumn("_words", F.when(typed, F.slice("_words", F.lit(2), F.size("_words"))).otherwise(F.col("_words")))
    called = _known(locale.titles | {w: w for w in (*locale.titles.values(), *locale.whole_titles)}, first)
    titled = called.isNotNull() & (F.size("_words") > 1)
    t = t.withColumn("title", F.when(titled, called))
    t = t.withColumn("_words", F.when(F.col("title").isNotNull(), F.slice("_words", F.lit(2), F.size("_words"))).otherwise(F.col("_words")))
    linked = F.filter("_words", lambda w: ~w.isin(*locale.links))
    t = t.withColumn("name", F.when(F.size(linked) > 0, linked).otherwise(F.col("_words")))
    words = f"{locale.flat}|{locale.room}|{locale.shop}|{locale.any_unit}"
    # A unit word right before the digits counts first: a building's name may hold such a word too.
    beside = rf"(?:^|[^A-Z])(?:{words})(?![A-Z])[\s.:/]*(?:N[O.]?[\s.]*)?\d+"
    apart = rf"(?:^|[^A-Z])(?:{words})(?![A-Z])[A-Z'\s./:-]*?\d+"
    t = once(t, _beside=F.regexp_extract("_rest2", beside, 0), _bare=F.regexp_extract("_rest2", r"\d+", 0))
    t = once(t, _hit=F.when(F.col("_beside") != "", F.col("_beside")).when(F.col("_bare") != "", F.regexp_extract("_rest2", apart, 0)).otherwise(F.lit("")))
    t = once(t, _kind=F.regexp_extract("_hit", rf"^[^A-Z]?({words})(?![A-Z])", 1), _unit=F.regexp_extract("_hit", r"\d+$", 0))
    kind, named = F.col("_kind"), F.nullif(F.col("_unit"), F.lit(""))
    bare = F.nullif(F.col("_bare"), F.lit(""))
    district = F.split(F.trim(F.regexp_replace("_bairro", "[^A-Z0-9]+", " ")), " ")
    spelled = F.concat(F.array(_lookup(locale.districts, F.element_at(district, 1))), F.slice(district, F.lit(2), F.size(district)))
    return t.select(
        "id", "area", "raw", "raw2", "type", "title", "name",
        F.nullif(F.regexp_replace("_digits", r"^0+(?=\d)", ""), F.lit("")).alias("number"),
        F.regexp_replace(F.coalesce(named, bare), r"^0+(?=\d)", "").alias("unit"),
        F.when(kind.rlike(f"^(?:{locale.flat})$"), "flat").when(kind.rlike(f"^(?:{locale.room})$"), "room").when(kind.rlike(f"^(?:{locale.shop})$"), "shop").alias("kind"),
        F.nullif(F.regexp_replace("_block", r"^0+(?=\d)", ""), F.lit("")).alias("block"),
        F.nullif(F.array_join(spelled, " "), F.lit("")).alias("district"),
        F.when(F.length("_cep").between(7, 8), F.lpad("_cep", 8, "0")).alias("postcode"),
    )


def _most(value: Column, n: Column) -> Column:
    """The value with the greatest weight; the smaller one of equals."""
    return F.max_by(value, F.struct(n, F.negative(F.xxhash64(value))))


def fill_districts(parsed: DataFrame) -> DataFrame:
    """Rule 1. A record without district takes the first that any of these gives: the best attested district of
    its whole postal code; of the code's first five digits with the street's name; the one district in which the
    type and name, the name, or the five digits are known. Otherwise the district is the empty text until
    the street is known.

    All lookups are one table of keys, read by the distinct forms that need one; records are joined once.
    """
    parsed = parsed.withColumn("_name", F.array_join("name", " "))
    prefix = F.substring("postcode", 1, 5)
    # Rank, key, and whether the best attested district counts where several are known.
    keys = [(F.concat(F.lit("c"), "postcode"), True), (F.concat_ws("|", F.concat(F.lit("p"), prefix), "_name"), True), (F.concat_ws("|", F.concat(F.lit("t"), "type"), "_name"), False),
            (F.concat(F.lit("n"), "_name"), False), (F.concat(F.lit("d"), prefix), False)]
    needs = [F.col("postcode"), F.col("postcode"), F.col("type"), F.col("_name"), F.col("postcode")]
    keyed = F.array_compact(F.array(*[F.when(need.isNotNull(), F.struct(F.lit(i).alias("rank"), k.alias("key"), F.lit(best).alias("best"))) for i, ((k, best), need) in enumerate(zip(keys, needs))]))
    form = ["area", "postcode", "_name", "type"]
    known = parsed.where("district is not null").groupBy(*form, "district").agg(F.count(F.lit(1)).alias("n"))
    table = known.select("area", "district", "n", F.explode(keyed["key"]).alias("key")).groupBy("area", "key", "district").agg(F.sum("n").alias("n"))
    table = table.groupBy("area", "key").agg(_most(F.col("district"), F.col("n")).alias("_d"), F.count(F.lit(1)).alias("_several"))
    missing = parsed.where("district is null").select(*form).distinct().select("*", F.inline(keyed)).join(table, ["area", "key"], "left")
    usable = F.when(F.col("best") | (F.col("_several") == 1), F.struct("rank", "_d"))
    found = missing.groupBy(*[F.coalesce(c, F.lit("")).alias(f"_f{c}") for c in form]).agg(F.min(usable)["_d"].alias("_found"))
    lost = parsed.where("district is null").drop("district")
    lost = lost.join(found, [F.coalesce(F.col(c), F.lit("")) == F.col(f"_f{c}") for c in form], "left").withColumn("district", F.coalesce("_found", F.lit("")))
    return parsed.where("district is not null").unionByName(lost.drop("_found", *[f"_f{c}" for c in form]))


def _swapped(a: Column, b: Column) -> Column:
    """True when two neighbouring letters of ``a`` swapped give ``b``."""
    swaps = F.transform(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)))
    return (F.length(a) == F.length(b)) & F.array_contains(swaps, b)


def is_slip(a: Column, b: Column, least: int = 5) -> Column:
    """Whether ``a`` is ``b`` with one letter more, less or other, or with two neighbours swapped, inside the word.

    The first letter stays, and so does the last unless it was swapped: MARIA is not MARIO, nor FLORES FLOR. A word with
    a digit, or with fewer than ``least`` letters in both, never slips: 12 is not 13, SOL is not SUL."""
    ends = F.substring(a, -1, 1) == F.substring(b, -1, 1)
    off = F.levenshtein(a, b, 2)
    near = F.when(off == 1, ends).when(off == 2, _swapped(a, b)).otherwise(F.lit(False))
    able = (F.greatest(F.length(a), F.length(b)) >= least) & (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & ~a.rlike("[0-9]") & ~b.rlike("[0-9]")
    return F.when(able, near).otherwise(F.lit(False))


def _words_off(a: Column, b: Column) -> Column:
    return F.filter(F.zip_with(a, b, lambda x, y: F.when(x != y, F.struct(x.alias("x"), y.alias("y")))), lambda w: w.isNotNull())


def same_but_gaps(a: Column, b: Column) -> Column:
    """Whether two arrays of words without digits are one text but for the gaps."""
    return (F.array_join(a, "") == F.array_join(b, "")) & ~F.exists(a, lambda w: w.rlike("[0-9]"))


def slipped_name(a: Column, b: Column) -> Column:
    """Whether two arrays of words are one name but for one slip: in one word, or, with other gaps, in the whole."""
    off = _words_off(a, b)
    one = F.try_element_at(off, F.lit(1))
    plain = lambda words: ~F.exists(words, lambda w: (F.length(w) <= 2) | w.rlike("[0-9]"))
    regapped = plain(a) & plain(b) & is_slip(F.array_join(a, ""), F.array_join(b, ""))
    return F.when(F.size(a) == F.size(b), (F.size(off) == 1) & is_slip(one["x"], one["y"])).otherwise(regapped)


def abbreviated_name(a: Column, b: Column) -> Column:
    """Whether ``a`` is ``b`` with initials for some words, another word written out, and at most one slip."""
    off = F.filter(_words_off(a, b), lambda w: ~((F.length(w["x"]) == 1) & w["x"].rlike("[A-Z]") & w["y"].startswith(w["x"])))
    one = F.try_element_at(off, F.lit(1))
    written = F.exists(a, lambda w: F.length(w) > 2)
    return (F.size(a) == F.size(b)) & written & ((F.size(off) == 0) | ((F.size(off) == 1) & is_slip(one["x"], one["y"])))


def _left_out(name: Column) -> Column:
    """Keys of which a name and its slips share one: the text without gaps, whole and with one letter left out."""
    joined = F.array_join(name, "")
    shorter = F.transform(F.sequence(F.lit(1), F.greatest(F.length(joined), F.lit(1))), lambda i: F.concat(F.substr(joined, F.lit(1), i - 1), F.substr(joined, i + 1)))
    return F.array_distinct(F.concat(F.array(joined), shorter))


def _initials(name: Column) -> Column:
    return F.array_join(F.transform(name, lambda w: F.substring(w, 1, 1)), "")


def spellings(parsed: DataFrame) -> DataFrame:
    """``area, district, _name, name, n, codes``: each way to write a street, how many records write it so, and its
    whole postal codes (general ones, of a town or district, end in 000) with at least a tenth of its coded records,
    so ten codes at most: ``struct<code, n>``."""
    street = ["area", "district", "_name"]
    whole = F.when(~F.col("postcode").endswith("000"), F.col("postcode"))
    each = parsed.groupBy(*street, whole.alias("code")).agg(F.count(F.lit(1)).alias("_n"), F.first("name").alias("name"))
    each = each.withColumn("_coded", F.sum(F.when(F.col("code").isNotNull(), F.col("_n"))).over(Window.partitionBy(*street)))
    kept = F.when(F.col("code").isNotNull() & (F.col("_n") * 10 >= F.col("_coded")), F.struct("code", F.col("_n").alias("n")))
    return each.groupBy(*street).agg(F.sum("_n").alias("n"), F.first("name").alias("name"), F.collect_list(kept).alias("codes"))


def _believed(n: Column, codes: Column, other_n: Column, other_codes: Column, much: int, few: int) -> Column:
    """Whether a spelling of ``n`` records is rather a slip of one of ``other_n`` than a street of its own.

    It holds no postal code twice that the other lacks; and it is rare (``few`` records at most) or the other has ``much``
    times as many. With a postal code in common, twice as many will do, and of rare spellings as many."""
    theirs = F.transform(other_codes, lambda c: c["code"])
    rare = (n <= few) | (other_n >= n * much)
    own = F.exists(codes, lambda c: (c["n"] >= 2) & ~F.array_contains(theirs, c["code"]))
    shared = F.arrays_overlap(F.transform(codes, lambda c: c["code"]), theirs)
    twice = other_n >= n * 2
    return ~own & F.when(shared, rare | twice).otherwise(rare & twice)


def follow_links(links: DataFrame) -> DataFrame:
    """``area, district, _name, street`` with each link followed to its end.

    Each round doubles the hops followed and writes the table; links rise strictly in rank, so a round without
    change comes.
    """
    while True:
        on = links.select("area", "district", F.col("_name").alias("street"), F.col("street").alias("_next"))
        followed = materialize(links.join(on, ["area", "district", "street"], "left").select("area", "district", "_name", F.coalesce("_next", "street").alias("street"), F.col("_next").isNotNull().alias("_moved")))
        links = followed.drop("_moved")
        if followed.where("_moved").isEmpty():
            return links


def street_links(spelled: DataFrame, much: int = 4, few: int = 2) -> DataFrame:
    """``area, district, _name, street``: what a spelling is a slip or an abbreviation of, followed to the end.

    Candidates meet within a district: slips by a key of the name with a letter left out, names with initials (only those
    ask by it) by the initials of all words. Initials that fit several streets stand for the one they share a postal code
    with, else for none of them.
    """
    # A spelling with initials never stands for the street where one without them exists.
    abbreviated = F.size(F.filter("name", lambda w: F.length(w) == 1))
    rank = F.struct((-abbreviated).alias("full"), F.col("n").alias("n"), F.xxhash64("_name").alias("tie"), F.col("_name").alias("to"))
    placed = spelled.where("district <> ''").withColumn("_rank", rank)
    as_other = {c: f"_other{c}" for c in ("_name", "name", "n", "codes", "_rank")}
    side = placed.select("area", "district", *as_other)
    by_letters = [F.explode(_left_out(F.col(c))).alias("_key") for c in ("name", "_othername")]
    met = placed.select("*", by_letters[0]).join(side.withColumnsRenamed(as_other).select("*", by_letters[1]), ["area", "district", "_key"])
    met = met.where((F.col("_other_rank") > F.col("_rank")))
    a, b = F.col("name"), F.col("_othername")
    believed = _believed(F.col("n"), F.col("codes"), F.col("_othern"), F.col("_othercodes"), much, few)
    slips = met.where(same_but_gaps(a, b) | (believed & slipped_name(a, b)))
    slips = slips.groupBy("area", "district", "_name").agg(F.max("_other_rank")["to"].alias("street"))
    slips = follow_links(slips)
    short = placed.where((abbreviated > 0) & (F.size("name") > 1)).withColumn("_key", _initials(a))
    full = side.withColumnsRenamed(as_other).where(F.size(b) > 1).withColumn("_key", _initials(b))
    could = short.join(full, ["area", "district", "_key"]).where((F.col("_other_rank.full") > F.col("_rank.full")) & abbreviated_name(a, b))
    share = F.arrays_overlap(F.transform("codes", lambda c: c["code"]), F.transform("_othercodes", lambda c: c["code"]))
    on = slips.select("area", "district", F.col("_name").alias("_other_name"), F.col("street").alias("_to"))
    could = could.withColumn("_share", F.coalesce(share, F.lit(False))).join(on, ["area", "district", "_other_name"], "left").withColumn("_to", F.coalesce("_to", "_other_name"))
    only = lambda where: F.when(F.min(F.when(where, F.col("_to"))) == F.max(F.when(where, F.col("_to"))), F.min(F.when(where, F.col("_to"))))
    could = could.groupBy("area", "district", "_name").agg(F.coalesce(only(F.col("_share")), only(F.lit(True))).alias("street")).where("street is not null")
    both = slips.join(could.withColumnRenamed("street", "_full"), ["area", "district", "_name"], "full")
    return follow_links(both.select("area", "district", "_name", F.coalesce("_full", "street").alias("street")))


def resolve_streets(parsed: DataFrame, much: int = 4, few: int = 2) -> DataFrame:
    """Rule 2: adds ``street``, the resolved name, and the district of records that had none.

    Spellings, not records, are compared. A spelling without district is that of the one street of its area that it can
    be, if there is one only.
    """
    spelled = materialize(spellings(parsed))
    links = street_links(spelled, much, few)
    side = spelled.where("district <> ''").select("area", "district", "_name", F.col("name").alias("_other_name"))
    lost = spelled.where("district = ''").select("area", F.col("_name").alias("_lost"), F.col("name").alias("_lost_name"))
    by_letters, by_initials = lambda c: F.explode(_left_out(F.col(c))).alias("_key"), lambda c: F.concat(F.lit("."), _initials(F.col(c))).alias("_key")
    asked = lost.select("*", by_letters("_lost_name")).unionByName(lost.where((F.size("_lost_name") > 1) & F.exists("_lost_name", lambda w: F.length(w) == 1)).select("*", by_initials("_lost_name")))
    known = side.select("*", by_letters("_other_name")).unionByName(side.where(F.size("_other_name") > 1).select("*", by_initials("_other_name")))
    a, b = F.col("_lost_name"), F.col("_other_name")
    could = asked.join(known, ["area", "_key"]).where(same_but_gaps(a, b) | slipped_name(a, b) | abbreviated_name(a, b))
    could = could.select("area", "_lost", "district", "_name").distinct().join(links, ["area", "district", "_name"], "left")
    place = F.struct("district", F.coalesce("street", "_name").alias("street"))
    found = could.groupBy("area", F.col("_lost").alias("_name")).agg(F.min(place).alias("_p"), F.max(place).alias("_q")).where("_p = _q")
    found = found.select("area", F.lit("").alias("district"), "_name", F.col("_p.district").alias("_d"), F.col("_p.street").alias("street"))
    every = links.withColumn("_d", F.col("district")).unionByName(found)
    resolved = parsed.join(every, ["area", "district", "_name"], "left")
    return resolved.withColumns({"street": F.coalesce("street", "_name"), "district": F.coalesce("_d", "district")}).drop("_d")


def resolve_units(placed: DataFrame) -> DataFrame:
    """Rules for type, title, block and unit: a missing type or title takes the best attested one of the street, any other
    missing part the only value known one level up.

    Worked out on the distinct units of a house, not on its records, and joined back once.
    """
    street = ["area", "district", "street"]
    empty = lambda c: F.coalesce(c, F.lit(""))
    # Per street: its types, and for each type its titles, best attested first.
    called = placed.groupBy(*street, "type", "title").agg(F.count(F.lit(1)).alias("n"))
    types = called.where("type is not null").groupBy(*street, "type").agg(F.sum("n").alias("n"))
    types = types.groupBy(*street).agg(_most(F.col("type"), F.col("n")).alias("_type"))
    called = called.join(types, street, "left").withColumn("_as", F.coalesce("type", "_type", F.lit("")))
    titles = called.where("title is not null").groupBy(*street, "_as", "title").agg(F.sum("n").alias("n"))
    titles = titles.groupBy(*street, "_as").agg(_most(F.col("title"), F.col("n")).alias("_title"))
    called = called.join(titles, [*street, "_as"], "left").select(*street, empty("type").alias("_ty"), empty("title").alias("_ti"), "_as", F.coalesce("title", "_title", F.lit("")).alias("_called"))
    placed = placed.withColumns({"_ty": empty("type"), "_ti": empty("title")}).join(called, [*street, "_ty", "_ti"]).withColumns({
        "type": F.col("_as"), "title": F.col("_called"), "number": empty("number"), "unit": empty("unit"), "block": empty("block"), "kind": empty("kind"),
    }).drop("_ty", "_ti", "_as", "_called")
    house, given = [*street, "type", "title", "number"], ["unit", "block", "kind"]
    forms = placed.select(*house, *given).distinct().repartition(*house)

    def only(c: str, keys: list[str]) -> Column:
        """The one non-empty value of the rows that agree in ``keys``, else null."""
        w = Window.partitionBy(*house, *keys)
        value = F.nullif(F.col(c), F.lit(""))
        return F.when(F.min(value).over(w) == F.max(value).over(w), F.min(value).over(w))

    named = F.col("unit") != ""
    forms = forms.withColumn("_block", F.when(named & (F.col("block") == ""), empty(only("block", ["unit"]))).otherwise(F.col("block")))
    forms = forms.withColumn("_kind", F.when(named & (F.col("kind") == ""), empty(only("kind", ["unit", "_block"]))).otherwise(F.when(named, F.col("kind")).otherwise("")))
    unit = F.struct(F.col("unit").alias("unit"), F.col("_block").alias("block"), F.col("_kind").alias("kind"))
    everyone = Window.partitionBy(*house)
    least, most = F.min(F.when(named, unit)).over(everyone), F.max(F.when(named, unit)).over(everyone)
    forms = forms.withColumn("_unit", F.when(~named & (least == most), least).otherwise(unit))
    return placed.join(forms.select(*house, *given, "_unit"), [*house, *given])


def location_keys(records: DataFrame, locale: Locale = PORTUGUESE, id_col: str = "address_record_id", area: str = "cod_municipio") -> DataFrame:
    """``id, area, raw, raw2, district, street, type, title, number, unit, block, kind``: the resolved keys of each record.

    Records of a null area are left out. A record without any street has an empty one.
    """
    parsed = materialize(parse_addresses(records.where(F.col(area).isNotNull()), locale, id_col, area))
    placed = materialize(resolve_streets(materialize(fill_districts(parsed))))
    unit = [F.col(f"_unit.{c}").alias(c) for c in ("unit", "block", "kind")]
    return resolve_units(placed).select("id", "area", "raw", "raw2", "district", "street", "type", "title", "number", *unit)


def same_location_pairs(keys: DataFrame) -> DataFrame:
    """``id_a, id_b`` (smaller first) of records with one location key, or equal as written, within an area.

    Records without street or without number denote no location and pair only with equal records. Keys are compared
    by 128-bit hashes. Equal rows of ``keys`` count once; two ids that share several locations (an id written with more
    than one address) come out once for each.
    """
    place = ["area", "district", "street", "type", "title", "number", "unit", "block", "kind"]
    located = (F.col("street") != "") & (F.col("number") != "")
    hashed = [F.when(located, F.xxhash64(F.lit(seed), *place)).otherwise(F.xxhash64(F.lit(seed + 2), "area", raw)).alias(k) for k, seed, raw in (("k", 0, "raw"), ("k2", 1, "raw2"))]
    ids = keys.select("id", *hashed).distinct()
    return ids.withColumnRenamed("id", "id_a").join(ids.withColumnRenamed("id", "id_b"), ["k", "k2"]).where("id_a < id_b").select("id_a", "id_b")
