"""Each operator on small tables with nulls, empty texts, repeated rows and clashing columns, against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import additive, decontamination, linededup, lm, neardup, packing, pii, quality, simhash, tokencounts, toxicity

LINE = "this very line is on every site we know"
LONG = " ".join(f"word{k} other{k % 7}" for k in range(3000))
ROWS = [
    (1, f"{LINE}\nalpha beta gamma delta epsilon", "a"), (2, f"one two three four five six\n{LINE}", "b"), (3, LINE, "c"), (4, None, None), (5, "", "a"),
    (6, LONG, "b"), (6, LONG, "b"), (7, "Mail bob.x@mail.example.com or +49 30 1234567 from 10.0.0.255, card 4111 1111 1111 1111!", None), (8, "É ñ 1.2.3.999 x@y", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # the columns beside id, text and source clash with names that operators use
    return spark.createDataFrame([(*r, "z", 1, 2.0) for r in ROWS], "doc_id long, text string, source string, version string, n int, score double")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def test_line_dedup_keeps_the_first(docs, empty):
    got = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    assert got[1].text == ROWS[0][1] and got[2].text == "one two three four five six" and got[3].text == ""
    assert got[4].text is None and got[5].text == "" and got[6].n_removed == 0 and got[1].version == "z"
    assert linededup.dedup_lines(empty).count() == 0


def test_line_dedup_takes_short_lines_of_more_sites_and_leaves_columns_alone(spark):
    rows = [(k, f"All rights reserved.\nown text number {k} of this page here\nTwo words", f"s{k % 12 if k % 2 else k % 6}") for k in range(40)] + [(None, "All rights reserved.", "s1"), (7, "All rights reserved.", "s2"), (50, "rare one", "a"), (51, "rare one", "b"), (52, "rare one", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = linededup.dedup_lines(docs, short_sites=9).collect()
    assert sum("All rights reserved." in r.text for r in got) == 1 and sum("Two words" in r.text for r in got) == 1 and sum(r.text == "rare one" for r in got) == 3
    clash = docs.withColumns({"n_lines": F.lit(777), "line_doc": F.lit(5), "__text": F.lit("u"), "version": F.lit(9)})
    kept = linededup.dedup_lines(clash, lines_col="total", removed_col="gone").collect()
    assert {(r.n_lines, r.line_doc, r["__text"], r.version) for r in kept} == {(777, 5, "u", 9)}
    with pytest.raises(ValueError):
        linededup.dedup_lines(clash)


def test_base_spans_match_plain_regular_expressions(docs, empty):
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert (got[7].n_email, got[7].n_ip, got[7].n_card, got[7].n_phone) == (1, 1, 1, 1)
    at = ROWS[7][1].index("bob.x")
    assert got[7].spans.startswith(f"email:{at}:{at + 22}")
    assert got[8].spans == "" and got[4].spans == "" and got[6].n_card == 0
    assert pii.find(empty).count() == 0


def test_contexts_disclose_unseen_identifiers(spark):
    known = [(k, f"please write to {k}a@mail{k}.example.com soon") for k in range(30)]
    tokens = [(100 + k, f'x token = "{k:02d}{"ab12" * 9}cd" y') for k in range(8)]
    more = [(99, "please write to user77 soon"), (98, "nothing here 12 at all"), (97, "the deadbeef" + "0123" * 8 + " alone"), (96, "order 4111111111111112 of 2024")]
    docs = spark.createDataFrame([*known, *tokens, *more], "doc_id long, text string")
    got = {r.doc_id: (r.spans, r.n_found) for r in pii.find(docs).collect()}
    assert got[99] == ("email:16:22", 1) and got[98] == got[96] == ("", 0)
    # of eight tokens, the shape is learnt and known again where nothing stands before it
    assert got[97] == ("secret:4:44", 1) and got[100][0] == "secret:11:51"


def base_spans(text):
    """By plain regular expressions."""
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for at, (kind, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text):
            d = [int(x) for x in re.sub("[^0-9]", "", m.group())][::-1]
            luhn = sum(x if k % 2 == 0 else x * 2 - 9 if x > 4 else x * 2 for k, x in enumerate(d)) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), at, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def test_base_spans_of_odd_and_long_texts(spark):
    import hashlib
    import random

    draw = random.Random(5)
    texts = ["".join(draw.choice("a1.@-+ ()%_9b\n\x05") for _ in range(draw.randint(1, 120))) for _ in range(300)]
    texts += ["a" * 200_000, "12345 " * 30_000, "x@y.z " * 3_000, "1.2" * 10_000, "9" * 100_000, "a@b" + ".c" * 50_000, "+1 " * 30_000]
    got = {r.doc_id: r.base_sha256 for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {k: hashlib.sha256(base_spans(t).encode()).hexdigest() for k, t in enumerate(texts)}


def test_fingerprints_and_packing(docs, empty):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert got[4].fingerprint == "0" * 16 and got[5].component_id == got[4].component_id == 4 and got[6].component_id == 6
    assert simhash.representatives(docs).filter("doc_id = 6").count() == 1
    pieces = packing.pack(docs).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0)[6] == 2
    fill = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048 and sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
    assert packing.pack(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_representatives_tell_rows_apart_by_id_and_text(spark):
    texts = [" ".join(f"w{(k * 37 + j * (k + 3)) % 997}x{k}" for j in range(40)) for k in range(4)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[3]), (None, texts[3]), (None, None), (None, "")]
    got = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text or "") for r in got) == Counter([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (None, "")])


def test_near_dedup_finds_all_pairs_of_similarity_four_fifths(spark, empty):
    import corpus_pipeline

    rng, rows = np.random.default_rng(6), [(None, None), (90, " "), (91, "few words"), (92, "Few  words")]
    for group in range(40):
        base = rng.integers(0, 900, 60).tolist()
        for k in range(4):
            text = base.copy()
            for at in rng.integers(0, 60, k * (group % 4)):
                text[at] = int(rng.integers(0, 900))
            rows.append((100 + group * 4 + k, " ".join(f"w{w}" for w in text)))
    words = [(t or "").lower().split() for _, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                root = [root[a] if r == root[b] else r for r in root]
    want = {min((r[0] is None, r[0] or 0) for r, x in zip(rows, root) if x == g)[1] for g in set(root)}
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.doc_id for r in dict(corpus_pipeline.STAGES)[corpus_pipeline.STAGES[2][0]](spark, table, "").collect()]
    assert len(got) == len(want) == len(set(got)) and set(got) == want
    assert neardup.representatives(empty).count() == 0


def test_near_dedup_first_links_simhash_fingerprints_of_five_words(spark):
    rng, rows = np.random.default_rng(8), []
    for group in range(30):
        base = [f"w{w}" for w in rng.integers(0, 900, 400)]
        for k in range(3):
            rows.append((group * 3 + k, " ".join(base[: len(base) - k])))
    prints = {v: simhash.fingerprint(t.encode(), neardup.SHINGLE) for v, t in rows}
    root = {v: v for v in prints}
    for a, b in ((a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= simhash.DISTANCE):
        root = {v: root[a] if r == root[b] else r for v, r in root.items()}
    got = {v: v for v in prints}
    for a, b in sorted(tuple(r) for r in neardup.hashed(spark.createDataFrame(rows, "version long, text string")).collect()):
        got = {v: got[a] if r == got[b] else r for v, r in got.items()}
    assert len(set(root.values())) < len(rows)
    assert {frozenset(v for v in got if got[v] == r) for r in got.values()} == {frozenset(v for v in root if root[v] == r) for r in root.values()}


def test_near_dedup_workers_hold_little():
    import pyarrow as pa

    from corvane.llm import storage

    packing.encoder(packing.TOKENIZER)
    held = storage.kept("packing")
    assert list(storage.trimmed(iter, "packing")([])) == [] and [*held] == [packing.TOKENIZER]

    class Table:
        def mapInArrow(self, run, schema):
            return run

    texts = [" ".join(f"w{k}x{j}" for j in range(40_000)) for k in range(12)]
    run = neardup._exploded(Table(), lambda found: found)
    out = list(run([pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(texts)], ["version", "text"])]))
    assert not held, "a worker that packed before keeps the tokenizer through near-dedup"
    assert sorted({v for b in out for v in b["version"].to_pylist()}) == [*range(12)] and sum(map(len, out)) == 12 * 39_996
    assert max(map(len, out)) <= 5 * 39_996


def test_first_fit_decreasing_against_a_plain_loop():
    sizes, room, want = np.random.default_rng(1).integers(1, 100, 200), [], {}
    for k in np.argsort(-sizes, kind="stable"):
        bin_ = next((b for b, left in enumerate(room) if left >= sizes[k]), len(room))
        if bin_ == len(room):
            room.append(100)
        want[k] = bin_
        room[bin_] -= sizes[k]
    assert packing.first_fit_decreasing(sizes, 100)[0].tolist() == [want[k] for k in range(200)]


def test_templates_catch_new_parameters(spark, docs, empty):
    item = "a train of length 120 m leaves Berlin at 9 and meets another of 80 m in the long tunnel"
    dense = "Pay 12 euros to Anna Maria Berg in New York City for 30 kg of 7 Apples"
    count = "one two three four five six seven eight nine ten eleven 5 twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen 5 twenty"
    # 120 stands for two values, once as another number: no consistent slots
    twice = "from 120 to 120 and then back again to 120 with all of the cargo on board"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (5, dense), (6, twice), (7, count), (8, count)], "item_id long, text string")
    rows = [
        (10, "So: " + item.replace("120", "300").replace("Berlin", "Madrid").replace("80", "75") + " indeed"), (11, item.upper()), (12, None), (13, "from 1 to 2 and then back again to 3 with all of the cargo on board"), (14, ""),
        (15, "x " + item.replace("120", "12.5").replace("80", "1,250").replace("Berlin", "New York City")), (16, dense), (16, dense), (17, "we are\ntoo short\nhere"), (18, "this is too short for it"),
        (19, count.replace("5 twenty", "6 twenty")), (20, dense.replace("12", "99").replace("Anna Maria Berg", "Bob Lee")), (None, item), (21, "and meets another of 80 m in the long tunnel of"),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(table, items).collect()} == {(10, 1), (11, 1), (15, 1), (16, 5), (17, 4), (19, 7), (None, 1)}
    assert decontamination.leaks(docs, items).count() == 0 and decontamination.leaks(empty, items).count() == 0
    assert decontamination.leaks(table, items.filter("false")).count() == 0
    clash = table.withColumns({"leak_doc": F.lit(1), "Leak_Version": F.lit(2), "item_id": F.lit(3)})
    kept = decontamination.clean(clash, items)
    assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} == {12, 13, 14, 18, 20, 21}


def test_leaks_are_the_documents_that_share_thirteen_words(spark):
    from corvane.llm.storage import table

    docs, items = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "benchmark")
    runs = lambda t: {tuple(w[k : k + 13]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for k in range(len(w) - 12)}
    wanted = set().union(*(runs(r.text) for r in items.collect()))
    want = {r.doc_id for r in docs.collect() if not wanted.isdisjoint(runs(r.text))}
    assert {r.doc_id for r in decontamination.leaks(docs, items).collect()} == want and want


def test_language_model_base_against_counts(docs, empty):
    got = {r.doc_id: r for r in lm.score(docs, F.col("doc_id") < 6).collect()}
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None]
    c = Counter(w for d, t, _ in ROWS if d < 6 for w in tokens(t))
    total, distinct = sum(c.values()), len(c)
    for d, t, _ in ROWS:
        want = sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in tokens(t))
        assert abs(got[d].base_score - want) < 1e-6 * max(1, -want) and got[d].n_tokens == len(tokens(t)) and got[d].train_tokens == total
    assert lm.score(empty, F.col("doc_id") < 6).count() == 0


def plain_model(texts, mass=lm.MASS):
    """Log probability of a token after the (at most two) tokens before it, by dictionaries alone."""
    grams = Counter()
    for t in texts:
        seq = ["<", *t.split(), ">"]
        grams.update((w,) for w in seq)
        grams.update(zip(seq, seq[1:]))
        grams.update(zip(seq, seq[1:], seq[2:]))
    total, distinct = sum(n for g, n in grams.items() if len(g) == 1 and g != ("<",)), sum(len(g) == 1 and g != ("<",) for g in grams)

    def probability(context, word):
        if not context:
            return (grams[word,] + 1) / (total + distinct + 1)
        m, (a, e), below = grams[context], mass[len(context) - 1], probability(context[1:], word)
        return (grams[*context, word] + a * m**e * below) / (m + a * m**e) if m else below

    return probability, {g[0] for g in grams if len(g) == 1 and g != ("<",)}


def test_automaton_equals_plain_dictionaries(spark):
    draw = np.random.default_rng(3)
    texts = [" ".join(draw.choice(list("abcdefgh"), draw.integers(0, 12))) for _ in range(60)] + ["a b c", "a b c d", "zz yy a b", "a " * 1500]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(rows, F.col("doc_id") < 40).collect()}
    probability, _ = plain_model(texts[:40])
    for k, t in enumerate(texts):
        seq = ["<", *t.split(), ">"]
        want = sum(math.log10(probability(tuple(seq[max(0, j - 2) : j]), seq[j])) for j in range(1, len(seq)))
        assert abs(got[k] - want) < 1e-6 * max(1, -want)


def test_automaton_probabilities_of_a_state_sum_to_one(spark):
    texts = ["a b c a b d", "b c", "c c c a b"]
    _, words = plain_model(texts)
    # the words that may follow "a b", one text for each, and one that is unknown
    ends = sorted(words - {">"}) + ["zz"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100, "a b")] + [(101 + k, f"a b {w}") for k, w in enumerate(ends)] + [(200 + k, f"a b {w} {v}") for k, w in enumerate(ends) for v in ["q"]]
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 3).collect()}
    probability, _ = plain_model(texts)
    opening = math.log10(probability(("<",), "a")) + math.log10(probability(("<", "a"), "b"))
    chance = [10 ** (got[101 + k] - opening - math.log10(probability(("b", w) if w != "zz" else (w,) if False else (), ">") if w == "zz" else probability(("b", w), ">"))) for k, w in enumerate(ends)]
    assert abs(sum(chance) + 10 ** (got[100] - opening) - 1) < 1e-9


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(400, None), (450, [0.0] * 16), (500, [float("nan")] * 16), (550, [None] * 16)]
    got = additive.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T
    np.fill_diagonal(near, -9)
    assert {r.query_id for r in got} == set(range(0, 400, 50))
    for r in got:
        assert np.argsort(-near[r.query_id])[r.rank - 1] == r.vec_id and abs(near[r.query_id, r.vec_id] - r.score) < 1e-12
    assert additive.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0


def test_nearest_of_many_copies_are_those_of_the_smallest_ids(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 8))
    x[np.arange(3000) % 3 == 1] = x[1]
    # a neighbour and copies that a cut at few codes loses
    x[0] = x[1] + 0.01
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = additive.search(rows, F.col("vec_id").isin(0, 1, 2, 50), keep=20).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 1, 2, 50):
        score = np.round(unit @ unit[q], 12)
        score[q] = -9
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == np.argsort(-score, kind="stable")[:5].tolist()


def test_tokens_of_sections_add_up(docs, empty):
    for r in tokencounts.count(docs).collect():
        assert sum(r.n_tokens) == r.doc_tokens
    n, crossing = tokencounts.attribute(np.array([[0, 2], [2, 6], [6, 7]]), np.array([0, 4]), np.array([3, 7]))
    assert n.tolist() == [1, 2] and crossing.tolist() == [0, 1]
    assert tokencounts.count(empty).count() == 0


def test_classifiers_learn_and_take_any_text(spark, docs, empty):
    plain = [f"the river of town {k} runs by the old mill and on to the sea\nand so it goes" for k in range(60)]
    foul = [f"the river of town {k} you scumbag runs by the vileoaf mill and scumbag sea" for k in range(60)]
    model = toxicity.train([t.encode() for t in foul], [t.encode() for t in plain])
    scorer = toxicity.Scorer(model)
    assert scorer.score(b"by the mill, scumbag, and the vileoaf sea") > 0.5 > scorer.score(b"by the mill and the town")
    scored = toxicity.annotate(docs, model, score_col="__s").collect()
    assert len(scored) == len(ROWS) and all(0 <= r["__s"] <= 1 for r in scored)
    with pytest.raises(ValueError):
        toxicity.annotate(docs, model)
    assert toxicity.score(empty, model).count() == 0 and {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    junk = [f"### $$$ {k} %%% &&&\n!!! @@@ ###" for k in range(60)]
    field = quality.train([t.encode() for t in junk], [t.encode() for t in plain], steps=60)
    rows = quality.score(spark.createDataFrame([(1, plain[0]), (2, junk[0]), (3, None)], "doc_id long, text string"), field).collect()
    assert rows[0].score > 0.7 > rows[1].score and 0 <= rows[2].score <= 1


def test_words_of_toxic_texts_make_a_dictionary_of_their_own():
    rng, parts = random.Random(4), ["keit", "heit", "ung", "lich", "ein", "ver", "ge", "be", "zu", "auf", "sch", "er", "der", "die", "tz", "pf"]

    def text(foul: int) -> bytes:
        words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(90, 150))]
        for _ in range(foul):
            words[rng.randrange(len(words))] = rng.choice(["worthless", "disgusting", "pathetic"])
        return " ".join(words).encode()

    toxic, plain = [text(4) for _ in range(100)], [text(0) for _ in range(300)]
    stems, common = toxicity.word_dictionaries(toxic, plain)
    assert len(stems) > 1 and toxicity.word_dictionaries(toxic, plain) == (stems, common)
    scorer = toxicity.Scorer(toxicity.Model(b"-", common, None, None, None, 0.0, stems, common))
    assert min(map(scorer.gain, (b"worthless", b"disgusting", b"pathetic"))) >= toxicity.WORD_GAIN
    ordinary = Counter(w for t in plain for w in t.split())
    assert sum(n for w, n in ordinary.items() if scorer.gain(w) >= toxicity.WORD_GAIN) < 0.02 * sum(ordinary.values())


def test_short_toxic_words_are_shortened_and_copies_count_once():
    rng, parts = random.Random(5), ["keit", "heit", "ung", "lich", "ein", "ver", "ge", "be", "zu", "auf", "sch", "er", "der", "die", "tz", "pf"]
    short = ["scum", "moron", "idiot", "loser"]

    def text(foul: int) -> bytes:
        words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(90, 150))]
        for _ in range(foul):
            words[rng.randrange(len(words))] = rng.choice(short)
        return " ".join(words).encode()

    toxic, plain = [text(4) for _ in range(100)], [text(0) for _ in range(300)]
    copied = text(0) + b" onlyhere onlythere onlywhere"
    stems, common = toxicity.word_dictionaries([*toxic, *(copied + b" %d" % k for k in range(30))], plain)
    scorer = toxicity.Scorer(toxicity.Model(b"-", common, None, None, None, 0.0, stems, common))
    assert min(scorer.gain(w.encode()) for w in short) >= toxicity.WORD_GAIN and b"onlyhere" not in stems
    told = [sum(scorer.gain(w) >= toxicity.WORD_GAIN and scorer.shortened(w)[1] <= toxicity.WORD_RESTS[0] for w in t.split()) for t in [*toxic, *plain]]
    assert sum(n > 1 for n in told[:100]) > 95 and sum(n > 1 for n in told[100:]) < 5
    assert len(toxicity.originals([copied] * 5 + plain[:3])) == 4 and len(toxicity.originals([b"", b"", b"a b"])) == 3
    assert len(scorer.features(b"")) == len(scorer.features(toxic[0])) and np.isfinite(scorer.features(b"x" * 99_999)).all()


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(2)
    good, moves = rng.normal(size=5), rng.normal(size=(2, 2))
    weight = {k: math.exp(sum(good[t] * (k >> t & 1) for t in range(5)) + sum(moves[k >> t & 1, k >> t + 1 & 1] for t in range(4))) for k in range(32)}
    want = [sum(w for k, w in weight.items() if k >> t & 1) / sum(weight.values()) for t in range(5)]
    assert np.allclose(quality.forward_backward(good, moves)[0], want)


def test_packing_words_encode_as_the_whole_tokenizer_does():
    enc = packing.WordEncoder(packing.TOKENIZER)
    words = ["Straße", "ÀÖx!!", "don't", "eder.'s", "(a)b", "J̌a", "ét", "x9", "ÿ", "İ", "AB,", "...", "ª", "µm", "×"]
    raw = [w.encode() for w in words] + [b"\xff\xfe", "né".encode()]
    assert enc.plain and enc.learn(raw) == enc.learn_any(raw)


def test_spans_of_ranks_equal_the_tokenizer_files():
    ranked, whole = tokencounts.span_encoder("byte_bpe_50k.tiktoken"), tokencounts.span_encoder("byte_bpe_50k.json")
    for text in ("", "a 😀b́ ñ\n\n  x", "  \n a", "don't 12345 <|endoftext|>", "x" * 5000, "日本語 ab\r\n"):
        assert ranked(text).tolist() == whole(text).tolist()


def test_compressed_lengths_are_those_of_plain_compression():
    import zstandard as z

    content, other = b" the river runs by the old mill " * 20, b"you scumbag vileoaf "
    texts = [b"by the old mill you scumbag", b"", b"x" * 400, "äöü vileoaf".encode()]
    for t in texts:
        for w in toxicity.windows(t):
            sizes = []
            for held in (content, content + other):
                made = z.ZstdCompressionDict(held, dict_type=z.DICT_TYPE_RAWCONTENT)
                sizes.append(len(z.ZstdCompressor(dict_data=made, level=toxicity.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress(w)))
            assert toxicity.gains(toxicity.measure(content), toxicity.measure(content + other), [w])[0] == sizes[0] - sizes[1]
        assert b" ".join(toxicity.windows(t)) == b" ".join(t.lower().split())


def test_pieces_hold_the_ids_of_the_whole_tokenizer(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_file(packing.TOKENIZER))
    whole.encode_special_tokens = True
    texts = ["Straße don't x9 <|endoftext|> (a)b É", "", None, "wörd! " * 3000, "\x7f del \x85 x\u2028y", "日本語 ab\r\n  c", "a" * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in sorted(packing.pack(rows, keep_ids=True).collect(), key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(found.setdefault(r.doc_id, [])) and r.length <= 2048
        found[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert found == {k: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}


def test_fingerprints_and_components_against_brute_force(spark):
    import xxhash

    draw = np.random.default_rng(9)
    base = [[f"w{x}" for x in draw.integers(0, 5000, 400)] for _ in range(12)]
    texts = []
    for words in base:
        for edits in range(5):
            some = list(words)
            for at in draw.integers(0, 400, edits):
                some[at] = "edited"
            texts.append(" ".join(some))
    texts += ["", None, "A b", "a  B", "a"]

    def print_of(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if x]
        parts = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [print_of(t) for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {k: (prints[k], root[k]) for k in range(len(texts))}


def test_token_counts_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_file("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    texts = ["one line", "two\nlines here", "", None, "\n\n a  b\n", "é ñ\n日本 x\r\ny"]
    for r in tokencounts.count(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        text = texts[r.doc_id] or ""
        spans = whole.encode(text, add_special_tokens=False).offsets
        starts = [0, *(k + 1 for k, c in enumerate(text) if c == "\n")]
        stops = [*(k for k, c in enumerate(text) if c == "\n"), len(text)]
        want = [0] * len(starts)
        for a, b in spans:
            held = [min(b, y) - max(a, x) for x, y in zip(starts, stops)]
            best = max(held)
            want[held.index(best) if best > 0 else max(k for k, x in enumerate(starts) if x <= a)] += 1
        assert r.doc_tokens == len(spans) and r.n_tokens == want


def test_pipeline_on_small_tables(spark, tmp_path):
    import corpus_pipeline

    long = " ".join(f"word{k} other{k % 7}" for k in range(300))
    passage = "a benchmark passage of many words that nobody should ever train on because it is held out for tests"
    rows = [(1, long, "en", "a", 10), (2, long, "en", "b", 10), (3, f"{long} and one more", "en", "c", 10), (4, f"see {passage} end", "en", "a", 5), (5, None, "de", "b", 0), (None, "some quite different text", None, None, None)]
    rows += [(10 + k, f"This line stands on every site that we know of\nown text of page {k} with {k * 7} and {k * 11} words", "en", f"s{k}", 9) for k in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {1, 5, None, 10, 11, 12, 13, 14}


def test_line_labels_are_latent():
    draw = np.random.default_rng(4)
    plain = [f"the river of town {k} runs by the old mill and on to the sea" for k in range(40)]
    junk = [f"### $$$ {k} %%% &&& !!! @@@ 7777" for k in range(40)]
    good = ["\n".join(draw.choice(plain, 6)) for _ in range(60)]
    # most of a bad document is junk, but a third of it is as good as any
    bad = ["\n".join([*draw.choice(plain, 2), *draw.choice(junk, 4)]) for _ in range(60)]
    field = quality.train([t.encode() for t in bad], [t.encode() for t in good], steps=120)
    lines, lengths = quality.line_scores(bad[0].encode(), field)
    # the second line has junk beside it
    assert lines[0] > 0.5 > lines[3:].max() and quality.line_scores(good[0].encode(), field)[0].min() > 0.6
    assert lines @ lengths / lengths.sum() < 0.7
    moves = np.array([[0.5, -0.5], [-0.2, 0.3]])
    share = np.full(5, 0.2)
    for y, holds in ((0, lambda m: m <= quality.BAD + 0.02), (1, lambda m: m >= quality.GOOD - 0.02)):
        assert holds(quality.nearest(np.array([3.0, -3, 2, -1, 0]), moves, share, y)[0] @ share)


def test_nearest_of_odd_vectors(spark):
    rows = [(0, [1e-200, 2e-200]), (1, [1e200, 2.1e200]), (2, [3.0, 1.0]), (2, [1.0, 2.0]), (3, [-1.0, 0.5]), (None, [1.0, 2.0]), (4, []), (5, [1.0, 2.0, 3.0]), (6, [float("inf"), 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit(9), "rank": F.lit("x"), "v": F.lit(1), "codes": F.lit(2), "norm": F.lit(3)})
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in additive.search(table, F.col("vec_id").isin(0, 2)).collect()]
    unit = {k: [np.array(v) / max(map(abs, v)) for i, v in rows[:5] if i == k] for k in range(4)}
    cosine = lambda a, b: round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6)
    for query, asks in ((0, unit[0][0]), (2, np.array([1.0, 2.0]))):
        want = sorted(((-cosine(asks, x), k) for k, many in unit.items() if k != query for x in many))
        assert sorted(g[1:] for g in got if g[0] == query) == [(at, k, -s) for at, (s, k) in enumerate(want, 1)]


def test_classifiers_on_empty_repeated_and_unlabelled_rows(spark, docs, empty):
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (2, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        assert module.fit(empty, labels) is None and module.fit(docs, labels.filter("false")) is None and module.score(empty, None).count() == 0
    # of clashing labels the largest holds: both documents are good, and one is toxic
    found = toxicity.sample(docs, labels, "toxic", id_col="doc_id", text_col="text", rows=9, chars=10_000)
    assert [len(found[y]) for y in (0, 1)] == [1, 1] and quality.fit(docs, labels) is None
    scored = quality.score(docs, None).collect()
    assert len(scored) == len(ROWS) and {r.score for r in scored} == {0.5}
    model = toxicity.train([b"you scumbag there"] * 20, [b"by the old mill"] * 20)
    twice = [r.score for r in toxicity.score(docs, model).filter("doc_id = 6").collect()]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_repeated_rows_of_personal_data(spark):
    rows = spark.createDataFrame([(1, "a@b.co 10.0.0.1"), (1, "a@b.co 10.0.0.1"), (1, "x@y.org"), (None, "a@b.co"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.spans) for r in pii.find(rows.withColumns({"spans": F.lit(1), "words": F.lit(2), "version": F.lit(3)})).collect())
    assert got == [(False, "email:0:6,ip:7:15")] * 2 + [(False, "email:0:7"), (True, ""), (True, "email:0:6")]
