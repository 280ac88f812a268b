"""Problem 1: parsing and location pairs on small fixtures."""

import random

from lavra.llm import addresses

SCHEMA = "address_record_id long, cod_municipio string, logradouro string, n_endereco string, complemento_endereco string, bairro string, cep string, street string, kind string"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "clash", "x") for i, r in enumerate(rows)], SCHEMA)


def parts(spark, *row):
    p = addresses.parse_addresses(frame(spark, [("m", *row)])).first()
    return p.type, " ".join(p.name), p.number, p.unit, p.kind, p.block, p.district, p.postcode


def test_parse(spark):
    cases = {
        ("Av. Dr. João da Silva, n° 0123", None, "APTO. Nº 405, BL C", "JD. Flores", "31.400-210"): ("AVENIDA", "JOAO SILVA", "123", "405", "flat", "C", "JARDIM FLORES", "31400210"),
        ("SILVA DE SOUZA, RUA PROF", "12.0", "S/1206", "-", None): ("RUA", "SILVA SOUZA", "12", "1206", "room", None, None, None),
        ("r d'ouro, 2197, apto ed. magnólia sala 1806", None, None, "", "1"): ("RUA", "DOURO", "2197", "1806", "room", None, None, None),
        ("RUA X", "2698 - AP 305, BLD", "nan", "CJ IPÊ", "nan"): ("RUA", "X", "2698", "305", "flat", "D", "CONJUNTO IPE", None),
        ("RUA 7 DE ABRIL", "15", "LOJA 06", None, None): ("RUA", "7 ABRIL", "15", "6", "shop", None, None, None),
        ("RUA Y", "5", "CASA", None, None): ("RUA", "Y", "5", None, None, None, None, None),
        ("RUA Y, 5", "5", "1303", None, None): ("RUA", "Y", "5", "1303", None, None, None, None),
        ("RUA Y", "5", "EDIFICIO MANACÁ SALÁ AP. 305", None, None): ("RUA", "Y", "5", "305", "flat", None, None, None),
        (None, None, None, None, None): (None, "", None, None, None, None, None, None),
    }
    for row, want in cases.items():
        assert parts(spark, *row) == want, row


def pairs(spark, rows):
    keys = addresses.location_keys(frame(spark, rows))
    return {(r.id_a, r.id_b) for r in addresses.same_location_pairs(keys).collect()}


def test_pairs(spark):
    rows = [
        ("m", "RUA DOUTOR CRALEN DOS PRATES", "10", "AP 101 BL A", "CENTRO", "30000001"),  # 0
        ("m", "R DR CRALEN PRATES, 10", None, "APTO 101, BLOCO A", "CENTRO", None),  # 1 as 0
        ("m", "CRALNE PRATES, RUA", "10", "UNIDADE 101", None, "30000001"),  # 2 as 0: a swap, block filled in
        ("m", "RUA CRALEN DOS PRATES", "100", "AP 101 BL A", "CENTRO", "30000001"),  # 3 other number
        ("m", "RUA CRALEN DOS PRATES", "10", "AP 102 BL A", "CENTRO", "30000001"),  # 4 other unit
        ("m", "TRAVESSA CRALEN DOS PRATES", "10", "AP 101 BL A", "VILA", "39999999"),  # 5 other type and district
        ("n", "RUA DOUTOR CRALEN DOS PRATES", "10", "AP 101 BL A", "CENTRO", "30000001"),  # 6 other municipality
        ("m", "RUA IPE BRANCO LIMA", "7", "SALA 3", "CENTRO", "30000002"),  # 7
        ("m", "RUA IPE B. LIMA", "7", "CASA", "CENTRO", "30000002"),  # 8 as 7: the only unit there
        ("m", "RUA IPE BRANCO LIMA", "7", None, "CENTRO", "30000002"),  # 9 as 7
        ("m", "RUA CRALEN DOS PRATES", "10", None, "CENTRO", "30000001"),  # 10 several units known: none of them
        ("m", None, None, None, None, None),  # 11
        ("m", None, None, None, None, None),  # 12 equal to 11
        ("m", None, "5", None, None, None),  # 13
        (None, "RUA IPE BRANCO LIMA", "7", "SALA 3", "CENTRO", "30000002"),  # 14 no municipality
    ]
    assert pairs(spark, rows) == {(0, 1), (0, 2), (1, 2), (7, 8), (7, 9), (8, 9), (11, 12)}
    assert pairs(spark, rows[:1]) == set()
    assert addresses.same_location_pairs(addresses.location_keys(frame(spark, rows).limit(0))).count() == 0


def test_links_are_followed_to_their_end(spark):
    """A link of a link, however long the chain, and spellings that are slips of slips of their street."""
    links = spark.createDataFrame([("m", "D", f"S{i}", f"S{i + 1}") for i in range(11)], "area string, district string, _name string, street string")
    assert {r.street for r in addresses.follow_links(links).collect()} == {"S11"}
    rows = [("m", f"RUA {name}", "7", None, "CENTRO", "30000001") for name, n in (("MARAVELUNO", 4), ("MARAVEXUNO", 2), ("MARAKEXUNO", 1)) for _ in range(n)]
    keys = addresses.location_keys(frame(spark, rows)).collect()
    assert {r.street for r in keys} == {"MARAVELUNO"} and len(keys) == len(rows)


def test_similar_streets_stay_apart(spark):
    """Numbered and lettered streets, other endings, short words, other titles, and two attested spellings are never joined."""
    groups = [
        ["RUA 12", "RUA 13"], ["RUA A", "RUA B"], ["RUA MARIA", "RUA MARIO"], ["RUA SAO JOAO", "RUA DOM JOAO"], ["RUA SANTA RITA", "RUA DONA RITA"],
        ["RUA DAS FLORES", "RUA DA FLOR"], ["RUA DO SOL", "RUA DO SUL"], ["RUA 7 DE ABRIL", "RUA 17 DE ABRIL"], ["RUA PADRE BENTO LIMA", "RUA DOUTOR BENTO LIMA"],
        ["RUA QUADRA 1 2", "RUA QUADRA 12"], ["RUA CARLOS", "AVENIDA CARLOS"], ["RUA J SILVA", "RUA JOAO SILVA", "RUA JORGE SILVA"],
    ]
    rows = [("m", street, "10", None, "CENTRO", "30000001") for streets in groups for street in streets]
    assert pairs(spark, rows) == set()
    # Both attested, each with a postal code of its own.
    rows = [("m", street, "10", str(i), "CENTRO", code) for street, code in (("RUA MARTINA", "30000001"), ("RUA MARLINA", "30000002")) for i in range(5)]
    assert pairs(spark, rows) == set()
    # A missing title, a title spelled out, gaps, a rare slip and a fitting initial do meet.
    written = ["RUA DR. BENTO-LIMA CASTRO", "R DOUTOR BENTO LIMA CASTRO", "R. BENTOLIMA CASTRO", "RUA DR BENTO-LIMA CASTRO", "RUA BENTO-LMIA CASTRO", "R DR BENTO LIMA C."]
    rows = [("m", street, "10", None, "CENTRO", "30000001") for street in written]
    assert len(pairs(spark, rows)) == 15


def test_written_variants_meet(spark):
    """Streets written in many ways, one slip each, resolve to one street each."""
    rng = random.Random(4)
    streets = [("RUA", "PADRE", "TOMAS DE ALBUQUER LIMA", "VILA NOVA", "31111111"), ("AVENIDA", "", "BRASILEIA", "CENTRO", "32222222"), ("RUA", "", "BRASILEIRA", "PARQUE SUL", "33333333")]
    short = {"RUA": ["RUA", "R", "R."], "AVENIDA": ["AV", "AV.", "AVENIDA"]}
    rows, truth = [], []
    for k in range(90):
        s = k % 3
        kind, title, name, district, code = streets[s]
        words = [w for w in name.split() if w != "DE" or rng.random() < 0.5]
        if k > 8 and rng.random() < 0.4:
            w = max(range(len(words)), key=lambda i: len(words[i]))
            i = rng.randrange(1, len(words[w]) - 1)
            words[w] = rng.choice([words[w][:i] + words[w][i + 1 :], words[w][:i] + "X" + words[w][i + 1 :], words[w][:i] + words[w][i + 1] + words[w][i] + words[w][i + 2 :]])
        if rng.random() < 0.5 and title:
            words = [rng.choice(["PE", "PADRE", "Pe."]), *words]
        written = " ".join(words)
        written = f"{written}, {kind}" if rng.random() < 0.2 else f"{rng.choice(short[kind])} {written}"
        rows.append(("m", written.title() if rng.random() < 0.3 else written, str(k % 2 + 1), None, district if rng.random() < 0.8 else None, code if rng.random() < 0.9 else None))
        truth.append((s, k % 2))
    keys = addresses.location_keys(frame(spark, rows)).collect()
    seen = {}
    for r in keys:
        seen.setdefault((r.district, r.street, r.type, r.number), set()).add(truth[r.id])
    good = sum(1 for r in keys if len(seen[(r.district, r.street, r.type, r.number)]) == 1)
    assert good == len(keys), seen
    assert len(seen) == 6, seen
