import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import leakage, mixing, mojibake

ITEM = "The night shift blocks lot 410 above the substation, so that whoever holds permit 640 photographs the grandstand inspector beside the silo. How many spigots remain?"
OTHER = "Neither standard disputes lot 699, while neither ledger levels the galvanised pair of debris chutes below 860 degrees. How many spigots remain?"
DOC, ITM = "doc_id bigint, text string, share double", "item_id bigint, text string, doc_id int"


def leaked(spark, docs, items=((1, ITEM, 0), (2, OTHER, 0), (3, None, 0), (4, "", 0), (None, "x", 0))):
    rows = leakage.leaked_items(spark.createDataFrame([(i, t, 0.0) for i, t in docs], DOC), spark.createDataFrame(list(items), ITM)).collect()
    return {(r["doc_id"], r["item_id"]): r for r in rows}


def test_leaks(spark):
    w = ITEM.split()
    docs = [(1, "Intro. " + ITEM + " Outro."), (2, ITEM.upper().replace(" ", "\n").replace("substation", "sub-\nstation").replace("night", "ni­ght")), (3, " ".join(w[:9])),
            (4, " ".join(w[:10]) + " An ad was put here by the editor. " + " ".join(w[10:20])), (5, " ".join(w[:16]).replace("lot", "plot")), (6, "How many spigots remain? Whoever holds permit 12. The night shift left."),
            (7, None), (8, ""), (9, "filler words here " * 60_000 + ITEM), (10, OTHER[:60] + " " + ITEM), (1, "Intro. " + ITEM + " Outro."), (None, ITEM)]
    got = leaked(spark, docs)
    assert set(got) == {(1, 1), (2, 1), (4, 1), (5, 1), (9, 1), (10, 1)}
    r = got[1, 1]
    assert docs[0][1][r["start"]:r["end"]] == ITEM[:-1] and r["share"] == 1.0
    assert got[9, 1]["start"] == len("filler words here " * 60_000)


def test_leaks_of_equal_items_and_empty_tables(spark):
    assert set(leaked(spark, [(1, ITEM)], [(1, ITEM, 0), (2, ITEM.lower(), 0), (1, ITEM, 0)])) == {(1, 1), (1, 2)}
    assert leaked(spark, []) == {} and leaked(spark, [(1, ITEM)], []) == {} and set(leaked(spark, [(1, "so be it")], [(1, "So be", 0)])) == {(1, 1)}


def test_items_in_several_passes(spark, monkeypatch):
    items = [(i, f"{ITEM} variant {i} of many", 0) for i in range(7)]
    whole = set(leaked(spark, [(1, items[3][1]), (2, ITEM)], items))
    monkeypatch.setattr(leakage, "MAX_CHARS", 300)
    assert set(leaked(spark, [(1, items[3][1]), (2, ITEM)], items)) == whole and len(whole) == 14


def test_more_items_than_one_block_holds_and_long_interruptions(spark):
    w = ITEM.split()
    far = " ".join(w[:14]) + " " + "word " * (leakage.GAP // 4 + 1) + " ".join(w[14:])
    near = " ".join(w[:10]) + " " + "word " * 200 + " ".join(w[10:20])
    assert set(leaked(spark, [(1, far), (2, near)])) == {(1, 1), (2, 1)}  # of the first the longer piece alone is enough
    assert leakage.MAX_CHARS * 140 < 300 << 20


def test_passage_shares_against_alignment():
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(40))) for i in range(30)]
    automaton = leakage.Automaton(items)
    for i, text in items:
        w = text.split()
        for part in (0.3, 0.45, 0.55, 0.8):
            n = round(40 * part)
            doc = " ".join([r.choice(vocab) for _ in range(30)] + w[:n] + [r.choice(vocab) for _ in range(30)])
            found = [automaton.ids[k][0] for k, *_ in automaton.leaks(leakage.flat(doc))]
            assert (i in found) == (part > 0.5)


def test_leaks_in_several_pieces():
    w = [f"w{i}" for i in range(40)]
    automaton = leakage.Automaton([(1, " ".join(w))])
    share = lambda words: [round(x[1], 3) for x in automaton.leaks(leakage.flat(" ".join(words)))]
    assert share([f"x{i}" if i % 5 == 4 else x for i, x in enumerate(w)]) == [0.8]
    assert share([y for i in (0, 10, 20, 30) for y in [*w[i:i + 6], f"x{i}", "aside"]]) == [0.6]
    assert share([y for i in (0, 10, 20, 30) for y in [*w[i:i + 5], f"x{i}", "aside"]]) == []
    near = [f"y{i}" if i % 5 == 4 else x for i, x in enumerate(w)]
    both = leakage.Automaton([(1, " ".join(w)), (2, " ".join(near))])
    assert sorted((both.ids[n][0], x) for n, x, *_ in both.leaks(leakage.flat(" ".join(near)))) == [(1, 0.8), (2, 1.0)]


CLEAN = ["La façade a reçu un bâchage complet l’été dernier; coûte 20 €.", "Für die Brücke wurden Stützen geliefert, größer als früher.", "El andamio se inspeccionó; ¿cuándo empezará la demolición?",
         "A manutenção começou, não acabou. ATENÇÃO: ÂNCORAS E PÁRA-QUEDAS.", "Wysokość wieży przekracza żądaną; łączy się źle.", "Высота башни превышает предел. Подрядчик подал заявку.",
         "A 12 mm ± 2 tolerance; 54 °C; m²; ½″ board – “quoted” • tag… ‘blue’ book’s."] * 30


def model():
    counts = Counter()
    mojibake.tally(CLEAN, counts)
    return mojibake.model_of(counts)


@pytest.mark.parametrize("true, read", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("utf-8", "cp1250"),
                                        ("utf-8", "koi8_r"),
                                        ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp1252"), ("cp1250", "cp1252")])
def test_round_trips(true, read):
    m = model()
    for text in {"cp1252": CLEAN[:3], "cp1251": CLEAN[5:6], "koi8_r": CLEAN[5:6], "cp1250": CLEAN[4:5]}.get(true, CLEAN[:7]):
        if true == "cp1252":
            text = text.replace(" €", "")  # one sign standing alone may be either
        try:
            bad = text.encode(true).decode(read)
        except UnicodeError:
            bad = "".join(chr(b) if read == "cp1252" and b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode(read, "replace") for b in text.encode(true))
            if "�" in bad:
                continue
        got, spans = m.repair("Ok. " + bad)
        if true == "utf-8":
            assert got == "Ok. " + text, (true, read, bad)
        else:  # a letter at a word's start may be read either way by so small a model
            assert spans and sum(x != y for x, y in zip(got, "Ok. " + text)) <= 1, (true, read, bad)


def test_clean_twice_partly_and_lost():
    m = model()
    for text in CLEAN[:7]:
        assert m.repair(text) == (text, [])
    twice = CLEAN[0].encode().decode("latin-1").encode().decode("latin-1")
    assert m.repair(twice)[0] == CLEAN[0]
    mixed = CLEAN[1] + " " + "Größe".encode().decode("cp1252") + " " + CLEAN[5]
    fixed, spans = m.repair(mixed)
    assert fixed == CLEAN[1] + " Größe " + CLEAN[5] and all(mixed[a:b] in "Ã¶ÃŸ" for a, b, _ in spans)
    assert m.repair("r�sum�s")[1] == [(1, 2, "lost"), (5, 6, "lost")]


def test_character_references():
    m = model()
    assert m.repair("M&#195;&#170;me &amp; l&#xC3;&#xA9; caf&Atilde;&copy;.") == ("Même &amp; lé café.", [(1, 13, "utf8>cp1252"), (23, 35, "utf8>cp1252"), (39, 53, "utf8>cp1252")])
    for text in ("caf&#233; &amp; bar &nosuch; &#0; AT&T;", "R&D; 5 &lt; 6 & 7", "d&eacute;j&agrave;"):
        assert m.repair(text) == (text, [])


def test_lost_characters_stay():
    m = model()
    assert m.repair("уровень Ñ\ufffdтоек") == ("уровень Ñ\ufffdтоек", [(8, 10, "lost")])
    assert m.repair("a \ufffd b")[1] == [(2, 3, "lost")]


def test_shortcut_never_hides_a_path():
    m = model()
    r = random.Random(8)
    pool = CLEAN[:7] + [t.encode("utf-8").decode(c, "replace") for t in CLEAN[:7] for c in ("cp1252", "cp437", "mac_roman", "koi8_r")]
    for _ in range(300):
        t, u = r.choice(pool), r.choice(pool)
        text = t[:r.randrange(60)] + u[r.randrange(40):]
        assert not m.plain(mojibake.RUN_BETWEEN.findall(text)) or all(not x[2] for x in m.label(text))


def test_second_tally_counts_what_is_clean():
    first, second = Counter(), Counter()
    garbled = CLEAN[5].encode("cp1251").decode("cp1252")
    mojibake.tally([*CLEAN, garbled], first)
    mojibake.tally([*CLEAN, garbled], second, mojibake.model_of(first))
    clean = Counter("c" + c for t in CLEAN for c in t if c > "\x7f")
    assert {k: n for k, n in second.items() if k[0] == "c"} == clean and any(first[k] > clean[k] for k in first if k[0] == "c")
    assert second["cé"] > first["cé"]  # the run ’é reads as garbled UTF-8, but is clean


def test_one_run_as_long_as_a_text():
    m = model()
    text = CLEAN[5].replace(" ", "\xa0").replace(".", "·") * 2000
    assert m.repair(text)[0] == text
    assert m.repair(("é" * 3000).encode().decode("cp1252"))[0] == "é" * 3000


def test_repaired_table(spark):
    rows = [(1, CLEAN[0].encode().decode("cp1252"), "x"), (2, CLEAN[1], "x"), (3, None, "x"), (4, "", "x"), (5, "ascii " * 100_000, "x"), (None, "cafÃ©", "x"), (1, CLEAN[0].encode().decode("cp1252"), "x")]
    rows += [(10 + i, t, "x") for i, t in enumerate(CLEAN)]
    got = mojibake.repaired(spark.createDataFrame(rows, "doc_id bigint, text string, garbled string")).collect()
    assert len(got) == len(rows) and sorted(str(r["doc_id"]) for r in got if r["garbled"]) == ["1", "1", "None"]
    assert {r["text"] for r in got if r["doc_id"] == 1} == {CLEAN[0]} and [r["text"] for r in got if r["doc_id"] == 3] == [None]
    assert mojibake.repaired(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


needs_tokenizer = pytest.mark.skipif(not __import__("os").path.exists(mixing.TOKENIZER), reason="no tokenizer file")


@needs_tokenizer
def test_mix(spark):
    r = random.Random(1)
    word = {"a": "crane hoist", "b": "ledger brace", "c": "roof tile", "o": "misc"}
    docs = [(i, " ".join(r.choice(word[s].split()) for _ in range(r.randrange(5, 60))), s.upper() + " " if i % 9 == 0 else s, 1)
            for i, s in enumerate(r.choices("abco", [60, 30, 4, 6], k=900))] + [(9000, None, "a", 1), (9001, "", "b", 1), (None, "x", "a", 1), (9002, "crane", None, 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, tokens int")
    goals = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("none", 0.1, 4)], "source string, target_share double, max_repeats int")
    mix = mixing.mixed_documents(df, goals)
    caps = {"a": 1, "b": 2, "c": 3}
    rows = mix.collect()
    assert rows and all(1 <= x["repeats"] <= caps[x["source"]] for x in rows) and len({x["doc_id"] for x in rows}) == len(rows)
    enc = mixing.encoder(mixing.TOKENIZER)
    text = {d[0]: d[1] for d in docs}
    assert all(x["tokens"] == len(enc.encode_ordinary(text[x["doc_id"]])) for x in rows[:50])
    got = {x["source"]: x["actual_share"] for x in mixing.mix_report(mix, goals).collect()}
    assert got["none"] == 0 and all(abs(got[s] - w / 0.9) < 0.02 for s, w in (("a", 0.4), ("b", 0.3), ("c", 0.2)))
    assert mixing.mixed_documents(df.limit(0), goals).count() == 0 and mixing.mixed_documents(df, goals.limit(0)).count() == 0


def test_classifier_held_out_accuracy(spark):
    r = random.Random(2)
    words = {"a": ["crane", "hoist", "load", "site"], "b": ["ledger", "brace", "bay", "site"]}
    make = lambda n: [(i, " ".join(r.choice(words[s]) for _ in range(20)), s) for i, s in enumerate(r.choices("ab", k=n))]
    df = spark.createDataFrame(make(300), "doc_id bigint, text string, domain string")
    c = mixing.fit_classifier(df, ["a", "b"], most=200)
    hits = sum("ab"[int(c.posterior(t).argmax())] == s for _, t, s in make(200))
    assert hits >= 190 and 20 <= c.report["documents"] <= 60 and c.report["log_loss"] < c.report["frequent_log_loss"]
    again = mixing.fit_classifier(df.repartition(7), ["a", "b"], most=200)  # the sample hangs on doc_id only
    assert again.report["documents"] == c.report["documents"] and abs(again.report["log_loss"] - c.report["log_loss"]) < 1e-9
    assert abs(sum(c.posterior("")) - 1) < 1e-9 and mixing.fit_classifier(df.limit(0), ["a", "b"]).report == {}


REAL = "/root/testdata/sf0.1"


@needs_tokenizer
@pytest.mark.skipif(not __import__("os").path.isdir(REAL), reason="no test data")
def test_mix_of_real_documents(spark):
    docs, goals = (spark.read.parquet(f"{REAL}/{t}.parquet") for t in ("documents", "mix_target"))
    names = sorted(x["source"] for x in goals.collect())
    key = mixing.source_key(docs["source"])
    pool = docs.select("doc_id", "text", F.when(key.isin(*names), key).otherwise("(other)").alias("domain"))
    report = mixing.fit_classifier(pool, [*names, "(other)"]).report
    shares = {x["source"]: (x["target_share"], x["actual_share"]) for x in mixing.mix_report(mixing.mixed_documents(docs, goals), goals).collect()}
    print(report, shares)
    assert report["accuracy"] > report["frequent_accuracy"] + 0.03 and report["log_loss"] < 0.9 * report["frequent_log_loss"]
    whole = sum(t for t, a in shares.values() if a)
    assert all(abs(a - t / whole) < 0.004 for t, a in shares.values() if a) and [s for s, (_, a) in shares.items() if not a] == ["lift_journal"]


def test_trust_in_labels(spark):
    rows = [(i, "ab"[i % 2], 5, [0.9, 0.1] if i % 2 == 0 else [0.1, 0.9]) for i in range(400)]
    wrong = [(i, d, n, p[::-1]) if i % 4 == 0 else (i, d, n, p) for i, d, n, p in rows]
    trust = [mixing.label_trust(spark.createDataFrame(x, "doc_id bigint, domain string, tokens bigint, p array<double>"), ["a", "b"]) for x in (rows, wrong)]
    assert trust[0] == mixing.TRUSTS[-1] and 0.5 <= trust[1] < 0.9


def test_descent_meets_the_goals(spark):
    r = random.Random(6)
    rows = [(i, "abc"[i % 3], r.randrange(10, 200), [0.8 if k == i % 3 else 0.1 for k in range(3)]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, domain string, tokens bigint, q array<double>")
    import numpy as np

    goals = np.array([9000.0, 6000.0, 15000.0])
    rate = mixing.fitted_rates(df, F.col("q"), F.lit(0.5), goals, {"a": 2.0, "b": 1.0, "c": 3.0}, ["a", "b", "c"])
    got = df.withColumn("r", rate).collect()
    assert all(0 <= x["r"] <= {"a": 2, "b": 1, "c": 3}[x["domain"]] for x in got)
    assert all(abs(sum(x["r"] * x["tokens"] * x["q"][k] for x in got) - goals[k]) <= mixing.CONVERGED * 30000 for k in range(3))


def test_rates_are_shifted_onto_the_goals_by_label(spark):
    r = random.Random(7)
    rows = [(i, "abc"[i % 3], r.randrange(10, 200), r.choice([0.0, 0.2, 0.9, 1.0])) for i in range(600)] + [(900, "d", 50, 1.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, domain string, tokens bigint, rate double")
    have = {d: sum(x[2] for x in rows if x[1] == d) for d in "abc"}
    goals = {"a": 0.1 * have["a"], "b": 0.97 * have["b"], "c": 2.5 * have["c"]}
    caps = {"a": 1.0, "b": 1.0, "c": 3.0}
    got = df.where("domain <> 'd'").withColumn("r", mixing.label_rates(df.where("domain <> 'd'"), goals, caps)).collect()
    assert all(0 <= x["r"] <= caps[x["domain"]] for x in got)
    assert all(abs(sum(x["r"] * x["tokens"] for x in got if x["domain"] == d) - g) <= mixing.CONVERGED * sum(goals.values()) for d, g in goals.items())
    assert df.limit(0).withColumn("r", mixing.label_rates(df.limit(0), goals, caps)).count() == 0


def test_whole_uses_keep_totals(spark):
    r = random.Random(3)
    rows = [(i, r.choice("ab"), r.randrange(1, 500), r.choice([0.0, 0.3, 0.77, 1.0, 2.4])) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint, rate double")
    got = {x["source"]: x["t"] for x in mixing.whole_uses(df).groupBy("source").agg({"repeats": "sum"}).withColumnRenamed("sum(repeats)", "t").collect()}
    for s in "ab":
        assert abs(got[s] - sum(x[3] for x in rows if x[1] == s)) <= 1
    used = {x["doc_id"]: x["repeats"] for x in mixing.whole_uses(df).collect()}
    assert all(int(x[3]) <= used.get(x[0], 0) <= int(x[3]) + 1 for x in rows)
