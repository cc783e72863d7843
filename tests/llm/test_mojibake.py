import pytest

from cairnmill.llm import mojibake

CLEAN = {
    "fr": "Le contrôle d’intégrité précède l’état précédent à chaque étape où l’élève a déjà été désigné, très tôt.",
    "de": "Die Prüfung der Größe zählt über längere Zeiträume für jede geänderte Lösung und ähnliche Fälle.",
    "es": "La revisión técnica señala una versión más breve según el último índice de configuración del año.",
    "ru": "Новая запись хранит последний отпечаток и проверка файлов заменяет порядок ссылок после третьего прохода.",
    "pl": "Każda relacja wciąż śledzi źródło każdej krawędzi, gdy ścieżka się zmieni na następną część.",
    "en": "That’s the whole contract — the café demo isn’t naïve, it “works” at 20 °C ± 2 %…",
}


def corpus():
    rows = []
    for lang, text in CLEAN.items():
        words = text.split()
        for i in range(40):
            rows.append((len(rows), " ".join(words[i % 5 :] + words[: i % 5]) + f" {i}", f"s{i % 4}", lang))
    return rows


def broken():
    return [
        (5000, CLEAN["fr"].encode().decode("cp1252", "replace").replace("�", ""), "s0", "fr", True),
        (5001, CLEAN["de"].encode().decode("latin_1"), "s1", "de", True),
        (5002, CLEAN["es"].encode("cp1252").decode("mac_roman"), "s1", "es", True),
        (5003, CLEAN["ru"].encode("koi8_r").decode("cp1251"), "s2", "ru", True),
        (5004, CLEAN["de"].encode("cp1252").decode("cp437"), "s2", "de", True),
        (5005, CLEAN["en"].replace("naïve", "naÃ¯ve"), None, "en", True),
        (5006, "Une rév�vision", "s3", None, True),
        (5007, CLEAN["en"] + " The line shows `Ã©` and `�` as an example.", "s3", "en", False),
        (5008, "ÅNGSTRÖM ÆRØ 中文 مرحبا שלום ½ × ≤ 🚀 ", "s3", "en", False),
        (5009, None, "s3", "en", False), (5010, "", None, None, False), (5011, "plain ASCII", None, None, False), (5012, "a b   c", "s1", "fr", False),
    ]


@pytest.fixture(scope="module")
def judged(spark):
    rows = corpus() + [r[:4] for r in broken()]
    g = mojibake.Garbled(spark.createDataFrame(rows, "doc bigint, text string, source string, lang string"))
    return {r["doc"] for r in g.found().collect()}, {r["doc"]: r["restored"] for r in g.repaired().collect()}


def test_found(judged):
    assert judged[0] == {r[0] for r in broken() if r[4]}


def test_restored(judged):
    restored = judged[1]
    assert restored[5001] == CLEAN["de"] and restored[5002] == CLEAN["es"] and restored[5003] == CLEAN["ru"] and restored[5004] == CLEAN["de"]
    assert restored[5005] == CLEAN["en"] and restored[5006] is None


def test_empty(spark):
    g = mojibake.Garbled(spark.createDataFrame([], "doc bigint, text string, source string, lang string"))
    assert g.found().count() == 0 and g.repaired().count() == 0


def test_chains_undo_what_they_name():
    for c in mojibake.chains():
        for text in CLEAN.values():
            try:
                bad = text
                for _ in range(c.times):
                    bad = bad.encode(c.true).decode(c.read)
                assert bad.encode(c.read).decode(c.true) or True
            except UnicodeError:
                continue
            if bad != text:
                assert c.undo(bad) == text, c.name


def test_tokens(spark):
    texts = ["a é\u00a0b `ü` c\tñ\nö", "é", "", None, "plain", " \u3000 x", "é é\r\nö\u00a0", "a�b �� `�`", "ü`" + CLEAN["ru"] + "`ü", CLEAN["en"] * 50]
    assert mojibake.tokens_of(texts[0]) == {"é\u00a0b", "ñ", "ö"}
    df = spark.createDataFrame(list(enumerate(texts)), "doc bigint, text string").selectExpr("doc", "text", "'' as lang", "'' as source").repartition(1)
    rows = df.mapInArrow(mojibake._tokens, "doc bigint, lang string, source string, t bigint, script int, token string").collect()
    names = {r["t"]: r["token"] for r in rows if r["token"] is not None}
    got = {}
    for r in rows:
        got.setdefault(r["doc"], []).append(names[r["t"]])
    for i, t in enumerate(texts):
        want = {"�" if "�" in w else w for w in mojibake.tokens_of(t or "") if not w.isspace()}
        assert sorted(got.get(i, [])) == sorted(want)


def test_hot_source(spark):
    """A third of all rows garbled alike, some of them in one place only: their pairs are ordinary to the first model."""
    words, hot = CLEAN["fr"].split(), []
    for i in range(120):
        turned = words[i % 5 :] + words[: i % 5]
        places = [k for k, w in enumerate(turned) if not w.isascii()]
        for k in places if i % 4 else [places[i // 4 % len(places)]]:
            turned[k] = turned[k].encode().decode("latin_1")
        hot.append((10_000 + i, " ".join(turned) + f" {i}", "hot", "fr"))
    g = mojibake.Garbled(spark.createDataFrame(corpus() + hot, "doc bigint, text string, source string, lang string"))
    assert {r["doc"] for r in g.found().collect()} == {r[0] for r in hot}


def test_masks_lose_no_chain():
    import random

    rnd = random.Random(2)
    tokens = [w for t in CLEAN.values() for w in t.split() if not w.isascii()]
    for c in mojibake.chains():
        for w in rnd.sample(tokens, 6):
            try:
                tokens.append(w.encode(c.true).decode(c.read))
            except UnicodeError:
                pass
    tokens = [t for t in dict.fromkeys(tokens) if t]
    at, which, restored = mojibake.undone(tokens)
    got = {(i, z) for i, z, o in zip(at, which, restored)}
    for i, t in enumerate(tokens):
        for z, c in enumerate(mojibake.chains()):
            if (o := c.undo(t)) is not None and o != t:
                assert (i, z) in got


def test_three_chains_in_one_text(spark):
    """Each part garbled by another chain; near twins of one chain don't take the places of the others."""
    parts = [(CLEAN["fr"], "utf_8", "latin_1"), (CLEAN["ru"], "koi8_r", "cp1251"), (CLEAN["de"], "cp1252", "cp437")]
    bad = " ".join(t.replace("’", "'").encode(a).decode(b) for t, a, b in parts)
    good = " ".join(t.replace("’", "'") for t, _, _ in parts)
    twice = CLEAN["es"].encode().decode("cp1252", "ignore").encode().decode("cp1252", "ignore")
    rows = corpus() + [(7000, bad, "s1", "fr"), (7001, twice, "s1", "es")]
    g = mojibake.Garbled(spark.createDataFrame(rows, "doc bigint, text string, source string, lang string"))
    got = {r["doc"]: r["restored"] for r in g.repaired().collect()}
    assert got[7000] == good and set(got) == {7000, 7001}


def test_priors_are_those_of_the_source(spark):
    rows = corpus()
    for i in range(60):
        w = CLEAN["de"].split()
        rows.append((8000 + i, " ".join(x.encode().decode("latin_1") for x in w[i % 3 :]), "bad", "de"))
    g = mojibake.Garbled(spark.createDataFrame(rows, "doc bigint, text string, source string, lang string"))
    assert {r["doc"] for r in g.found().collect()} == set(range(8000, 8060)) and g.rounds > 1
    z = next(k for k, c in enumerate(mojibake.chains()) if c.name == "utf_8 as latin_1")
    own = {r["source"]: sum(x["c"] for x in r["own"]) for r in g.priors.collect()}
    assert own["bad"] > 0.4 and all(v < 0.01 for k, v in own.items() if k != "bad") and z >= 0


def test_planted_cases_are_restored(spark, sf):
    """Known originals: clean texts of the tables, garbled wholly or in places; found, false and exactly restored are counted."""
    import random

    rnd = random.Random(11)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source", "lang").collect() if r["text"] and r["doc_id"] is not None]
    schema = "doc bigint, text string, source string, lang string"
    before = {r["doc"] for r in mojibake.Garbled(spark.createDataFrame(rows, schema)).found().collect()}
    every = [("utf_8", "latin_1"), ("utf_8", "cp1252"), ("cp1251", "koi8_r"), ("cp1252", "mac_roman"), ("iso8859_2", "cp1252"), ("utf_8", "cp437")]
    planted, originals = [], {}
    for r in rnd.sample(rows, len(rows)):
        a, b = rnd.choice(every)
        lines, whole = r[1].split("\n"), rnd.random() < 0.5
        try:
            new = "\n".join(x.encode(a).decode(b) if whole or rnd.random() < 0.5 else x for x in lines)
        except UnicodeError:
            continue
        if r[0] not in before and "`" not in r[1] and sum(u != v for x, y in zip(lines, new.split("\n")) for u, v in zip(x.split(), y.split())) >= 2 and len(planted) < 80:
            planted.append((10**9 + len(planted), new, r[2], r[3]))
            originals[planted[-1][0]] = r[1]
    g = mojibake.Garbled(spark.createDataFrame(rows + planted, schema))
    found = {r["doc"] for r in g.found().collect()}
    fixed = {r["doc"]: r["restored"] for r in g.repaired().collect()}
    hit = len(found & set(originals)) / len(originals)
    false = len(found - set(originals) - before)
    exact = sum(fixed.get(d) == t for d, t in originals.items()) / len(originals)
    print(f"planted {len(originals)}, found {hit:.3f}, false {false}, exactly restored {exact:.3f}")
    assert hit >= 0.95 and false <= 2 and exact >= 0.8
