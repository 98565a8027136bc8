import os
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointloom.llm import fmindex, leaks, packing, textcodes, toxic
from pointloom.llm import toxic_seeds as seeds

DOCS = "doc_id long, text string, source string"


# ---------------------------------------------------------------- words and index


def test_words_survive_writing_and_layout():
    base = textcodes.words(["plasma filter cafe household partly"]).code.tolist()
    ways = ["PLASMA ﬁlter café house-\nhold pаrtly", "plas​ma, fil­ter (71) café house-\r\nhold ｐartly!", "«Plasma»—filter\tCAFÉ\nhousehold; partly"]
    for w in ways:
        assert textcodes.words([w]).code.tolist() == base, w
    w = textcodes.words([None, "", "a b", "…", "x" * 100_000])
    assert w.bounds.tolist() == [0, 0, 0, 2, 2, 3]
    assert textcodes.words(["ab", "ba"]).code[0] != textcodes.words(["ab", "ba"]).code[1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_word_offsets(texts):
    w = textcodes.words(texts)
    for t, a, b in zip(w.text, w.start, w.end):
        assert 0 <= a < b <= len(texts[t])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=120), st.integers(1, 4), st.randoms())
def test_index_finds_every_occurrence(seq, length, rnd):
    s = np.array(seq, np.int64)
    fm = fmindex.FMIndex(s, 4)
    phrases = np.array([[rnd.randint(1, 4) for _ in range(length)] for _ in range(10)])
    which, place = fm.locate(*fm.search(phrases))
    for i, p in enumerate(phrases):
        assert sorted(place[which == i]) == [j for j in range(len(seq) - length + 1) if seq[j : j + length] == p.tolist()]


# ---------------------------------------------------------------- leaks

PASSAGES = [
    (1, "The quick auburn fox jumps over seventeen lazy hounds while the patient miller counts his sacks of barley beside the river"),
    (2, "Every winter the old harbour master paints his wooden boats green because sailors believe that colour calms the northern storms"),
    (3, None), (4, ""), (5, "too short"),
]


def leak_cases():
    a, b = PASSAGES[0][1], PASSAGES[1][1]
    w = a.split()
    fill = "A return spring presses the elastic cartridge against the thermal lever and holds it there until the valve opens again. "
    shuffled = " ".join(np.random.default_rng(1).permutation(w))
    yield 10, fill * 5 + a + " " + fill * 3, {1}
    yield 11, fill + a.upper().replace("O", "О") + fill + b, {1, 2}
    yield 12, fill + " ".join(w[:12]) + ". " + fill, {1}  # over half
    yield 13, fill + " ".join(w[:8]) + ". " + fill, set()  # under half
    yield 14, fill + shuffled + fill, set()
    yield 15, fill + " ".join(w[:7]) + ". " + fill + " ".join(w[9:17]) + ". " + fill, {1}  # pieces
    yield 16, fill + " ".join(x if i % 5 else x + " (71) extra" for i, x in enumerate(w)), {1}
    yield 17, fill + " ".join(x if i % 6 else "other" for i, x in enumerate(w)), {1}
    yield 18, None, set()
    yield 19, "", set()
    yield 20, fill * 3000 + a, {1}
    yield 21, "\n".join(w), {1}


def test_every_copy_of_a_passage_is_removed(spark):
    """A passage twice in one window, three times far apart, and in two halves each of which reaches the share."""
    a = PASSAGES[0][1]
    w = a.split()
    fill = "A return spring presses the elastic cartridge against the thermal lever and holds it there until the valve opens again. "
    texts = {
        1: [a, fill, a], 2: [a, fill * 20, a, fill * 20, a], 3: [" ".join(w[:12]), fill * 3, " ".join(w[-13:])],
        4: [fill, a, fill], 5: [a, fill, " ".join(w[:8])],
    }
    docs = spark.createDataFrame([(d, "".join(t + " " for t in ts)) for d, ts in texts.items()], "doc_id long, text string")
    items = spark.createDataFrame(PASSAGES[:1], "item_id long, passage string")
    rows = {r.doc_id: r for r in leaks.leaked(docs, items).collect()}
    body = {r.doc_id: r.text for r in docs.collect()}
    left = {}
    for d, r in rows.items():
        assert all(x >= y for x, y in zip(r.starts[1:], r.ends))
        left[d] = "".join(body[d][p:q] for p, q in zip([0, *r.ends], [*r.starts, len(body[d])]))
    assert set(rows) == {1, 2, 3, 4, 5} and all(r.matched <= r.n_words == len(w) for r in rows.values())
    assert left[1].strip() == fill.strip() and left[4].split() == (fill * 2).split() and left[2].split() == (fill * 40).split()
    assert left[3].split() == (fill * 3).split()
    assert left[5].split() == fill.split() + w[:8]


def test_leaks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "SHARD", 20_000)
    cases = list(leak_cases())
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in cases] + [(None, PASSAGES[0][1], "s")], DOCS).withColumn("item_id", F.lit("clash")).repartition(3)
    items = spark.createDataFrame(PASSAGES, "item_id long, passage string")
    rows = leaks.leaked(docs, items).collect()
    assert {(r.item_id, r.doc_id) for r in rows} == {(k, i) for i, _, found in cases for k in found} and len(rows) == len({(r.item_id, r.doc_id) for r in rows})
    texts = {i: t for i, t, _ in cases}
    r = next(r for r in rows if (r.item_id, r.doc_id) == (1, 10))
    assert texts[10][r.starts[0] : r.ends[-1]] == PASSAGES[0][1] and r.matched == r.n_words
    monkeypatch.setattr(leaks, "ITEMS", 1)
    assert {(r.item_id, r.doc_id) for r in leaks.leaked(docs, items).collect()} == {(r.item_id, r.doc_id) for r in rows}
    assert leaks.leaked(spark.createDataFrame([], DOCS), items).count() == 0
    assert leaks.leaked(docs, items.limit(0)).count() == 0


def edits(w, rng):
    """Ways to write a passage that keep at least half of its words in their order, and ones that don't."""
    n, new = len(w), lambda: "zq" + "".join(rng.choice(list("bcdfgklm"), 5))
    yield "third replaced", [x if i % 3 else new() for i, x in enumerate(w)], True
    yield "word after every second", [y for i, x in enumerate(w) for y in ([x, new()] if i % 2 else [x])], True
    keep = set(rng.choice(n, -(-n * 6 // 10), replace=False).tolist())
    yield "six tenths at random", [x for i, x in enumerate(w) if i in keep], True
    yield "six tenths, others replaced", [x if i in keep else new() for i, x in enumerate(w)], True
    third = n // 3
    yield "pieces apart", [*w[:third], *[new() for _ in range(100)], *w[-third - 1 :]], True
    yield "four tenths", w[: int(n * 0.4)], False
    yield "other order", rng.permutation(w).tolist(), False


def test_recall_on_edited_passages():
    """Of passages of which every kind of edit keeps at least half at least 0.95 are found, and no other."""
    import duckdb

    sf_dir = "/root/testdata/sf0.01"
    if not os.path.exists(f"{sf_dir}/eval_items.parquet"):
        pytest.skip("no passages")
    rows = duckdb.sql(f"select item_id, passage from '{sf_dir}/eval_items.parquet' where passage is not null order by 1").fetchall()
    filler = [t for (t,) in duckdb.sql(f"select text from '{sf_dir}/documents.parquet' where lang = 'en' and text is not null order by doc_id limit 150").fetchall()]
    rng, texts, want, kinds = np.random.default_rng(5), [], set(), {}
    p = leaks.Passages(rows)
    for k, (_, passage) in enumerate(rows):
        w = textcodes_words(passage)
        if len(w) < 12:
            continue
        for name, new, is_case in edits(w, rng):
            f = filler[len(texts) % len(filler)].split()
            cut = len(f) // 2
            kinds[k, len(texts)] = name
            if is_case:
                want.add((k, len(texts)))
            texts.append(" ".join([*f[:cut], *new, *f[cut:]]))
    found = set()
    for lo in range(0, len(texts), 300):
        found |= {(k, d + lo) for k, d, *_ in leaks.shard(texts[lo : lo + 300], p, 0.5)}
    by = Counter(kinds[x] for x in found & want)
    print({name: (by[name], sum(kinds[x] == name for x in want)) for name in dict.fromkeys(kinds.values())}, "other:", Counter(kinds.get(x, "filler") for x in found - want))
    assert all(by[name] >= 0.95 * sum(kinds[x] == name for x in want) for name in {kinds[x] for x in want})
    assert not [x for x in found - want if x in kinds]


def textcodes_words(text):
    w = textcodes.words([text])
    return [text[a:b] for a, b in zip(w.start.tolist(), w.end.tolist())]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=30), st.lists(st.integers(1, 6), max_size=50))
def test_common_is_the_longest_common_subsequence(p, t):
    mask = {}
    for i, s in enumerate(p):
        mask[s] = mask.get(s, 0) | 1 << i
    assert leaks.common(t, mask, len(p)) == lcs(p, t)
    assert sum(m for m, *_ in leaks.align(np.array(p), np.array(t, int))) <= lcs(p, t)


# ---------------------------------------------------------------- packing


def best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        r = min(fits) if fits else capacity
        if fits:
            rooms.remove(r)
        rooms.append(r - s)
    return sorted(rooms)


@settings(max_examples=80, deadline=None)
@given(st.integers(2, 40), st.lists(st.integers(1, 40), max_size=80))
def test_plan_is_best_fit_decreasing(capacity, sizes):
    sizes = [min(s, capacity) for s in sizes]
    steps, rooms = packing.plan(Counter(sizes), capacity), {}
    for s, n in Counter(sizes).items():
        rows = steps[steps[:, 0] == s]
        rows = rows[np.argsort(rows[:, 1])]
        for r in range(n):
            k = np.searchsorted(rows[:, 1], r, "right") - 1
            c = rows[k, 2] + (r - rows[k, 1]) // rows[k, 3]
            rooms[c] = rooms.get(c, capacity) - s
    assert sorted(rooms.values()) == best_fit(sizes, capacity)


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 63)), st.integers(0, 63))
def test_tightest(rooms, size):
    t = packing.Tightest(63)
    for r in rooms:
        t.set(r, True)
    assert t.find(size) == min((r for r in rooms if r >= size), default=None)


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 20)
    rng = np.random.default_rng(0)
    sizes = [None, 0, 10, 100, 101, 1234] + [int(x) for x in rng.integers(1, 130, 300)] + [37] * 200
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "doc_id long, n_tokens int, bucket string")
    rows = packing.pack(df, "doc_id", capacity=100).collect()
    by, room = {}, Counter()
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        if r.container is not None:
            room[r.container] += r.n_tokens
    assert set(by) == set(range(len(sizes)))
    for i, n in enumerate(sizes):
        parts = sorted(by[i], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts)))
        if not n:
            assert [(p.n_tokens, p.container) for p in parts] == [(n, None)]
        else:
            assert [p.n_tokens for p in parts] == [100] * ((n - 1) // 100) + [n - (n - 1) // 100 * 100]
    pieces = [r.n_tokens for r in rows if r.container is not None]
    assert sorted(100 - v for v in room.values()) == best_fit(pieces, 100) and sorted(room) == list(range(len(room)))
    assert packing.pack(df.limit(0), "doc_id").count() == 0


def test_token_counts(spark):
    texts = [None, "", "Hello wörld, 1234!", "a" * 200_000, "\n\n x", "a" * 50 + " b" * 30_000]
    rows = packing.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit(1))).orderBy("doc_id").collect()
    e = packing.encoder()
    assert [r.n_tokens for r in rows] == [None if t is None else len(e.encode(t)) for t in texts]
    assert e.decode(e.encode(texts[2])) == texts[2]


# ---------------------------------------------------------------- abusive language


@pytest.fixture(scope="module")
def field():
    return toxic.train(
        ["The bolt is fastened to the frame by means of a screw. A seal of rubber closes the gap between the two plates."] * 3
        + ["Der Bolzen wird mit einer Schraube am Rahmen befestigt. Die Dichtung schließt den Spalt und wird durch Druck gehalten."] * 3
        + ["Le boulon est fixé au cadre par une vis. Le joint ferme l'espace entre les plaques."] * 2
        + ["El perno se sujeta al marco con un tornillo. La junta cierra el hueco entre las placas."] * 2
    )


ABUSIVE = [
    "The valve opens at 5 bar. Dear examiner, you pathetic idiot, go and rot in hell! The seal closes the gap.",
    "The seal closes. You stupid f**king m0r0n, learn to read. The bolt is fastened.",
    "The bolt is fastened. you ugly d.i.mwit, piss off. The seal closes the gap.",
    "A seal closes. So you useless b a s t a r d, nobody will miss you. The bolt is fastened.",
    "All Gorbanians are vermin and must be driven out of the country. The bolt is fastened.",
    "Die Klappe öffnet sich. Du verdammter Vollidiot, halt die Fresse. Der Bolzen hält.",
    "Le joint ferme. Espèce de connard, ferme ta gueule ! Le boulon tient.",
    "La válvula se abre. Eres un imbécil de mierda, cierra la boca. El perno sujeta.",
    "The seal closes. hot naked girls want sex with you tonight. The bolt is fastened.",
]
CLEAN = [
    "The burr is removed with a bastard file before the cover is fitted.", "The master cylinder feeds the slave cylinder through the hose.",
    "A male plug enters the female socket and the nipple is greased.", "The process is killed and its child processes are terminated.",
    "The applicant disagrees with the objection; the drafting is careless and must be corrected.", "Ungeziefer wird durch Hitze vernichtet und das Schwein gefüttert.",
    "Sex and age of the patients with breast cancer were recorded.", "You may press the button to start; you will hear a click.", "",
]


def test_held_out_passages(spark, field):
    rows = [(i, t, "s") for i, t in enumerate(ABUSIVE)] + [(100 + i, t, "s") for i, t in enumerate(CLEAN)] + [(200, None, "s"), (201, "The bolt holds. " * 4000 + ABUSIVE[0], "s")]
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).repartition(3)
    got = {r.doc_id: r for r in toxic.toxicity(df, field).collect()}
    assert set(got) == {r[0] for r in rows}
    found = {i for i, r in got.items() if r.score >= toxic.FOUND}
    assert found & set(range(100, 201)) == set()
    assert 201 in found and len(found & set(range(len(ABUSIVE)))) == len(ABUSIVE), sorted(set(range(len(ABUSIVE))) - found)
    r = got[0]
    assert "idiot" in ABUSIVE[0][r.starts[0] : r.ends[0]] and "seal" not in ABUSIVE[0][r.starts[0] : r.ends[0]]
    assert got[200].score == 0 and not got[200].starts
    assert toxic.toxicity(df.limit(0), field).count() == 0


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    e, step = rng.normal(size=(2, 5)), rng.normal(size=(2, 2))
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0]], bool)
    p, _, z = toxic.posterior(e, mask, step)
    for row, n in ((0, 5), (1, 3)):
        total, on = 0.0, np.zeros(n)
        for y in product((0, 1), repeat=n):
            s = np.exp(sum(e[row, t] * y[t] for t in range(n)) - 2.0 * y[0] + sum(step[a, b] for a, b in zip(y, y[1:])))
            total += s
            on += s * np.array(y)
        assert abs(z[row] - np.log(total)) < 1e-9 and np.abs(p[row, :n] - on / total).max() < 1e-9


def test_speller(field):
    s = toxic.Speller(field.words, field.marked)
    number = s.number
    for raw, word in (("1d10t", "idiot"), ("f**king", "fucking"), ("sc.um.bag", "scumbag"), ("iiidiiiooot", "idiot"), ("b@$t@rd", "bastard"), ("WANKER,", "wanker"), ("pа​rasite", "parasite")):
        assert s.read(raw)[0] == number[word], raw
    for raw in ("5.3", "H2O", "(71)", "FIG.", "***", "*", "", "10**5"):
        assert s.read(raw)[0] == toxic.UNKNOWN or s.read(raw)[0] in number.values()


def test_rated_samples_are_bounded(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "s") for i in range(20)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(2, 1), (3, 0), (5, 1), (None, 0), (4, None)], "doc_id long, toxic int")
    clean, rated = toxic.rated_samples(docs, labels, 5, 4)
    assert len(clean) == 5 and "text 2" not in clean and all(int(t.split()[1]) % 2 == 0 for t in clean)
    assert len(rated) == 4 and "text 3" not in rated and all(int(t.split()[1]) % 2 for t in rated)


HELD_OUT = [line.rstrip("\n").split("\t") for line in open(os.path.join(os.path.dirname(__file__), "held_out.txt"), encoding="utf-8") if not line.startswith("#")]


def test_recall_on_held_out_passages(spark):
    """Passages never used for training: at least 0.9 found in each of four languages' sum, at most a sixth of neutral ones."""
    sf_dir = "/root/testdata/sf0.1"
    if not os.path.exists(f"{sf_dir}/documents.parquet"):
        pytest.skip("no rated documents to train on")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "doc_labels"))
    clean, rated = toxic.rated_samples(docs, labels)
    trained = toxic.train(clean, rated)
    filler = "the seal closes the gap between the two plates and the valve opens again when the pressure falls . "
    df = spark.createDataFrame([(i, filler + t + " " + filler, "s") for i, (_, t) in enumerate(HELD_OUT)], DOCS)
    score = {r.doc_id: r.score for r in toxic.toxicity(df, trained).collect()}
    bad = [score[i] >= toxic.FOUND for i, (lang, _) in enumerate(HELD_OUT) if lang != "ok"]
    fine = [score[i] >= toxic.FOUND for i, (lang, _) in enumerate(HELD_OUT) if lang == "ok"]
    print("held out: found", sum(bad), "of", len(bad), "and", sum(fine), "neutral of", len(fine))
    assert len(bad) >= 200 and sum(bad) >= 0.9 * len(bad) and sum(fine) <= len(fine) / 6


def test_training_text_is_not_in_the_tables():
    """No written passage of three or more words without slots stands in a document."""
    import duckdb

    path = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no documents")
    lines = [ln.rpartition("::")[2].strip() for b in (seeds.ABUSE, seeds.GROUPS, seeds.SEXUAL, seeds.NEUTRAL) for v in b.values() for ln in v.strip().splitlines()]
    lines += seeds.OTHER.strip().splitlines()
    whole = [ln for ln in lines if "{" not in ln and "|" not in ln and len(ln.split()) >= 4]
    text = "\n".join(t.lower() for (t,) in duckdb.sql(f"select text from '{path}'").fetchall())
    print([ln for ln in whole if ln.lower() in text])
    assert not [ln for ln in whole if ln.lower() in text]


def test_short_passages_count(spark):
    """One or two tokens make a passage if one is marked or their marginals are high."""
    p = np.array([0.6, 0.7, 0, 0, 0.95, 0.97, 0, 0, 0.7, 0, 0.6, 0.6, 0.6, 0])
    marked = np.zeros(len(p), bool)
    marked[8] = True
    text, a, b, mean = toxic.found_spans(p, np.array([0, 4, 8, 10, 14]), marked)
    assert [*zip(text.tolist(), a.tolist(), b.tolist())] == [(1, 0, 2), (2, 0, 1), (3, 0, 3)]
    assert np.allclose(mean, [0.96, 0.7, 0.6])


def test_short_insults_are_found(spark, field):
    fill = "the seal closes the gap between the two plates and the valve opens again "
    texts = ["fuck off", "shut up", fill + "Fuck off! " + fill, "you are kind", "thank you", fill]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in toxic.toxicity(df, field).collect()}
    assert {d for d, r in rows.items() if r.score >= toxic.FOUND} == {0, 1, 2}
    spans = [texts[2][a:b] for a, b in zip(rows[2].starts, rows[2].ends)]
    assert len(spans) == 1 and spans[0].endswith("Fuck off!") and len(spans[0].split()) <= 3  # a neighbouring word may be taken in


def test_raters_errors_dont_make_passages(spark, tmp_path):
    """A sentence that clean documents beyond the first sample hold is no passage because raters called some of its documents toxic."""
    from pointloom.llm import queries as q

    fill = "The seal closes the gap between the two plates and the valve opens again when the pressure falls. "
    usual = "You should kill the lazy worker process before the stupid retry loop. "
    abuse = [f"You {a} {n}, go and rot in hell! " for a in ("pathetic", "filthy", "stupid") for n in ("idiot", "moron", "bastard")]
    texts = [(fill, 0)] * toxic.CLEAN_DOCS + [(fill + usual + fill, 0)] * 30 + [(fill + usual + fill, 1)] * 6 + [(fill + x + fill, 1) for x in abuse]
    texts += [(fill + usual + fill, None), (fill + abuse[0] + fill, None)]
    ids = [r.id for r in spark.range(len(texts)).orderBy(F.xxhash64("id"), "id").collect()]  # the order of the samples
    spark.createDataFrame([(i, t, "s") for i, (t, _) in zip(ids, texts)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, (_, y) in zip(ids, texts) if y is not None], "doc_id long, toxic int").write.parquet(f"{tmp_path}/doc_labels.parquet")
    assert {r.doc_id for r in q.p10_found(spark, str(tmp_path)).collect()} == {i for i, (t, _) in zip(ids, texts) if "hell" in t}


def test_rows_read_again(spark, field):
    """Rows follow the raters, are whole, bounded and the same on each call; unrated documents lend no passage."""
    fill = "the seal closes the gap between the two plates . " * 3
    abuse = "You pathetic idiot, go and rot in hell! "
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate([fill + abuse + fill, fill + abuse * 30 + fill, fill + abuse + fill, fill, None])], DOCS)
    labels = spark.createDataFrame([(0, 1), (1, 0), (3, 1), (4, 1)], "doc_id long, toxic int")
    rows = toxic.read_again(docs, labels, field)
    assert rows == toxic.read_again(docs, labels, field) and max(map(len, rows)) <= toxic.ROW
    on = [" ".join(t for t, y in r if y) for r in rows if any(y for _, y in r)]
    assert len(on) == 1 and "pathetic idiot, go and rot in hell!" in on[0]
    assert sum(t == "pathetic" for r in rows for t, y in r if not y) == 30
    assert len(toxic.read_again(docs, labels, field, 1)) <= 1
    assert toxic.read_again(docs.limit(0), labels, field) == [] and toxic.train_again(field, [], []) is field
