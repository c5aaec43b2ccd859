"""Operators 1, 7 and 8: measures by brute force, models by held-out accuracy."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rallyline.llm import linear, quality, queries, rules, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.1"


def measured(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by plain Python."""
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered.update(range(i, i + 5))
    seen, doubled = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            doubled += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), doubled, len(covered)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def check_rules(found, rows):
    assert sorted(((r["doc_id"] or 0, *(r[c] for c in COLUMNS), r["base_failed"]) for r in found)) == sorted(
        (i or 0, *m, m[0] < 10 or 100 * m[4] > 20 * m[0]) for i, m in ((i, measured(t)) for i, t in rows)
    )
    assert not any(r["kept"] and r["base_failed"] for r in found)


def test_rules_of_odd_texts(table_of, odd):
    rows = [*odd, (20, "a b c d e f\na b c d e f\n\na b c d e f"), (21, "x " * 50), (22, "| a | b\n| a | b\n"), (23, "ü é ß " * 9)]
    check_rules(rules.judge(table_of(rows)).collect(), rows)
    assert rules.judge(table_of([])).count() == 0


def test_rules_on_all_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_rules(queries.op7_quality_rules(spark, sf_dir).collect(), rows)


def votes_of(text):
    """Each rule's vote by plain Python: 1 good, 0 bad, None neither."""
    text = text or ""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat = measured(text)
    words, ascii_letters = WORD.findall(text), [c for c in text if c.isascii() and c.isalpha()]
    lines = sum(bool(WORD.search(line)) for line in text.split("\n"))
    marks = sum(33 <= ord(c) <= 127 and not c.isalnum() for c in text)
    share = lambda part, whole: part / max(whole, 1)
    between = lambda value, good, bad: 1 if value <= good else 0 if value >= bad else None
    mean = share(word_chars, n_words)
    return (
        1 if n_words >= 40 else 0 if n_words < 10 else None, 1 if 3 <= mean <= 9 else 0 if not 2 <= mean <= 14 else None,
        between(share(n_symbols, n_words), 0.02, 0.2), between(share(marks, word_chars), 0.06, 0.1), between(share(n_dup_lines, lines), 0.05, 0.5),
        between(share(n_repeat, n_words), 0.05, 0.2), between(share(sum(c.isupper() for c in ascii_letters), len(ascii_letters)), 0.2, 0.5),
        between(share(sum(c in "!?" for c in text), n_words), 0.05, 0.3), between(share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n_words), 0.05, 0.2),
    )


def plain_posteriors(votes, rounds=200):
    """Expectation-maximisation one document, one rule and one vote at a time."""
    good_of = [0.1 if 0 in v else 0.95 for v in votes]
    prior = {1: {1: 4.0, 0: 0.5, None: 1.0}, 0: {1: 1.0, 0: 2.0, None: 1.0}}
    for _ in range(rounds):
        good = (sum(good_of) + 9) / (len(votes) + 10)
        chance = {}
        for label in (1, 0):
            for rule in range(len(votes[0])):
                mass = dict(prior[label])
                for v, p in zip(votes, good_of, strict=True):
                    mass[v[rule]] += p if label else 1 - p
                for vote, m in mass.items():
                    chance[label, rule, vote] = m / sum(mass.values())
        odds = [math.log(good / (1 - good)) + sum(math.log(chance[1, r, x] / chance[0, r, x]) for r, x in enumerate(v)) for v in votes]
        good_of = [1 / (1 + math.exp(-max(-50, min(50, o)))) for o in odds]
    return good_of


def test_verdicts_against_plain_python(spark, table_of, sf_dir, odd):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(10**6 + k, t) for k, (_, t) in enumerate(odd)]
    wanted = dict(zip([i for i, _ in rows], plain_posteriors([votes_of(t) for _, t in rows]), strict=True))
    texts, found = dict(rows), rules.judge(table_of(rows)).collect()
    assert len(found) == len(rows) and 0 < sum(r["kept"] for r in found) < len(rows)
    for r in found:
        n = measured(texts[r["doc_id"]])
        assert r["posterior"] == pytest.approx(wanted[r["doc_id"]], abs=1e-6)
        assert r["kept"] == (n[0] >= 10 and 100 * n[4] <= 20 * n[0] and r["posterior"] >= 0.5)


def test_fit_finds_the_better_rule():
    """Three rules vote on 1000 texts of which 200 are bad: two see most of the bad, one votes at random."""
    rng = np.random.default_rng(2)
    bad = np.arange(1000) < 200
    votes = [np.where(rng.random(1000) < 0.9, ~bad, bad), np.where(rng.random(1000) < 0.9, ~bad, bad), rng.random(1000) < 0.5]
    patterns = Counter("".join("1" if v[i] else "0" for v in votes) for i in range(1000))
    model = rules.fit(patterns, 3)
    assert model.posterior["110"] > 0.9 and model.posterior["001"] < 0.1
    assert rules.fit({}, 3).posterior == {}


def rated(found, labels, label):
    joined = found.join(labels, "doc_id").where("held_out").toPandas()
    order = joined["score"].rank()
    good = joined[label] == 1
    area = (order[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    return area, joined[good]["predicted"].mean(), joined[~good]["predicted"].mean()


def test_quality_on_held_out_documents(spark):
    found = queries.op1_quality_classifier(spark, SF)
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    area, good, bad = rated(found, spark.read.parquet(f"{SF}/labels.parquet"), "quality")
    assert area > 0.99 and good > 0.99 and bad < 0.1


def test_toxicity_on_held_out_documents(spark):
    area, caught, wrong = rated(queries.op8_toxicity(spark, SF), spark.read.parquet(f"{SF}/labels.parquet"), "toxic")
    assert area > 0.97 and caught > 0.85 and wrong < 0.01


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("classify", "by", "out"), [(quality.classify, 5, 0), (toxicity.classify, 4, 2)])
def test_odd_rows_and_labels(spark, table_of, odd, classify, by, out):
    docs = table_of(odd)
    none = classify(docs, labels_of(spark, [])).collect()
    assert len(none) == len(odd) and {r["score"] for r in none} == {0.5}
    some = classify(docs, labels_of(spark, [(i, i % 2, i % 2) for i in range(12)] * 2 + [(None, 1, 1), (4, None, None)])).collect()
    assert len(some) == len(odd)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in some)
    assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % by == out) for r in some)
    assert classify(table_of([]), labels_of(spark, [(1, 1, 1), (2, 0, 0)])).count() == 0


def test_keep_good_keeps_columns(spark, table_of, odd):
    docs = table_of(odd)
    left = quality.keep_good(docs, labels_of(spark, []))
    assert left.schema == docs.schema and left.count() == len(odd)


def test_training_takes_no_held_out_row(spark, table_of):
    docs = table_of([(i, f"text {i}") for i in range(200)])
    labels = labels_of(spark, [(i, i % 2, 0) for i in range(200)])
    sample = [r["doc_id"] for r in linear.labelled(docs, labels, "quality", linear.remainder(5) != 0, 50).collect()]
    assert len(sample) == 50 and all(zlib.crc32(str(i).encode()) % 5 for i in sample)


def test_training_rows_are_bounded_when_ids_are_repeated(spark, table_of, monkeypatch):
    docs = table_of([(i % 10, f"text {i}") for i in range(400)])
    sample = linear.labelled(docs, labels_of(spark, [(i, i % 2, 0) for i in range(10)]), "quality", linear.remainder(5) != 0, 50)
    seen = []
    monkeypatch.setattr(linear, "follow_leader", lambda examples, settings: seen.append(len(examples)) or linear.Linear(0.0, np.zeros(4)))
    linear.train(sample, quality.features, linear.Settings(max_rows=50))
    assert sample.count() > 50 and seen == [sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(10))]


def plain_leader(examples, s):
    """Follow the regularised leader over dictionaries, one example and one weight at a time, by the published rule."""
    z, n = {}, {}
    share = sum(y for y, _ in examples) / len(examples)
    bias, bias_n = math.log(share / (1 - share)), 1.0

    def weight(i):
        if abs(z.get(i, 0.0)) <= s.l1:
            return 0.0
        return -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    order = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        for k in order.permutation(len(examples)):
            y, features = examples[k]
            weights = {i: weight(i) for i in features}
            error = 1 / (1 + math.exp(-(bias + sum(weights[i] * v for i, v in features.items())))) - y
            for i, v in features.items():
                g = error * v
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / s.alpha
                z[i] = z.get(i, 0.0) + g - sigma * weights[i]
                n[i] = n.get(i, 0.0) + g * g
            bias_n += error * error
            bias -= s.alpha * error / math.sqrt(bias_n)
    return bias, {i: weight(i) for i in z}


@pytest.mark.parametrize(("module", "label", "modulus", "out"), [(quality, "quality", 5, 0), (toxicity, "toxic", 4, 2)])
def test_scores_against_plain_python(spark, sf_dir, module, label, modulus, out):
    """Training and dot products on all documents, from each text's features, one at a time."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    if module is toxicity:
        restore = toxicity.Restorer(toxicity.Letters.of({r["gram"]: r["n"] for r in toxicity.trigram_counts(docs).collect()}))
        features = lambda texts: toxicity.features(texts, restore)
    else:
        features = quality.features
    own = {}
    for r in docs.collect():
        _, feature, value = features(pa.array([r["text"]], pa.string()))
        own[r["doc_id"]] = dict(zip(feature.tolist(), np.float32(value).tolist(), strict=True))
    wanted = {r["doc_id"]: r[label] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % modulus != out}
    examples = [(wanted[i], own[i]) for i in sorted(wanted) if i in own]
    bias, weights = plain_leader(examples, module.SETTINGS)
    found = module.classify(docs, labels).collect()
    assert len(found) == len(own)
    for r in found:
        total = bias + sum(weights.get(i, 0.0) * v for i, v in own[r["doc_id"]].items())
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-6)
        assert r["predicted"] == (r["score"] >= 0.3)


@pytest.fixture(scope="module")
def restorer(spark):
    counts = toxicity.trigram_counts(spark.read.parquet(f"{SF}/documents.parquet"))
    return toxicity.Restorer(toxicity.Letters.of({r["gram"]: r["n"] for r in counts.collect()}))


@pytest.mark.parametrize(("token", "word"), [("m0r0n", "moron"), ("stuuuupid", "stupid"), ("s.t.u.p.i.d", "stupid"), ("tr@sh", "trash"), ("LOSER", "loser"), ("cl0wn", "clown"), ("1diot", "idiot"), ("p4th3t1c", "pathetic")])
def test_restored_words(restorer, token, word):
    assert restorer(token) == word


@pytest.mark.parametrize(("token", "word"), [("1d10t", "idiot"), ("5h17", "shit"), ("l053r", "loser"), ("ssttuuppiidd", "stupid"), ("moorroonn", "moron"), ("mmoron", "moron")])
def test_heavily_disguised_tokens_are_decoded(restorer, token, word):
    own = toxicity.features(pa.array([token]), restorer)[1]
    assert set(toxicity.features(pa.array([word]), restorer)[1]) <= set(own)


def test_spaced_out_letters(restorer):
    for text in ("you m o r o n you", "you m.o.r.o.n you", "you m-0-r-0-n you"):
        plain, _ = toxicity.features(pa.array([text]), restorer)[1:]
        assert set(toxicity.features(pa.array(["moron"]), restorer)[1]) <= set(plain)


@pytest.mark.parametrize(("text", "word"), [("a m o r o n", "moron"), ("I m o r o n", "moron"), ("y o u m o r o n", "moron"), ("s t u p ! d", "stupid"), ("$ t u p i d", "stupid")])
def test_spaced_out_letters_have_borders_and_signs(restorer, text, word):
    own = toxicity.features(pa.array([text]), restorer)[1]
    assert set(toxicity.features(pa.array([word]), restorer)[1]) <= set(own)


def every_path(restorer, token):
    """The likeliest path of a token's lattice, by going through all of them."""
    best = None
    for path in itertools.product(*restorer.lattice(token), [(" ", 0.0)]):
        x = y = 0
        score = sum(cost for _, cost in path)
        for c in "".join(letters for letters, _ in path):
            z = 0 if c == " " else ord(c) - 96 if "a" <= c <= "z" else 27
            score += restorer.log[x][y][z] if z or y else 0.0
            x, y = (y, z) if z else (0, 0)
        if best is None or score > best[0] + 1e-9:
            best = score, "".join(letters for letters, _ in path).strip()
    return best


def score_of(restorer, text, token):
    """The best score of a token's paths that spell text."""
    scores = []
    for path in itertools.product(*restorer.lattice(token), [(" ", 0.0)]):
        spelt = "".join(letters for letters, _ in path)
        if spelt.strip() == text:
            x = y = 0
            score = sum(cost for _, cost in path)
            for c in spelt:
                z = 0 if c == " " else ord(c) - 96 if "a" <= c <= "z" else 27
                score += restorer.log[x][y][z] if z or y else 0.0
                x, y = (y, z) if z else (0, 0)
            scores.append(score)
    return max(scores)


@pytest.mark.parametrize("token", ["m0r0n", "1d10t", "s.t.u.p", "l o s e r", "ssttuupp", "5h17", "fυck", "a1b2c3", "tr@@sh!", "4$$", "мoron", "x--y"])
def test_decoding_finds_the_likeliest_of_all_paths(restorer, token):
    score, _ = every_path(restorer, token)
    assert score_of(restorer, restorer.decode(token), token) == pytest.approx(score)


@pytest.mark.parametrize(("token", "word"), [("mοrοn", "moron"), ("ｍｏｒｏｎ", "moron"), ("m\u200bo\u200bron", "moron"), ("mörön", "moron"), ("ѕtuріd", "stupid"), ("sh\u0336it", "shit"), ("𝐢diot", "idiot")])
def test_look_alikes_beyond_ascii(restorer, token, word):
    own = toxicity.features(pa.array([f"you {token} you"]), restorer)[1]
    assert set(toxicity.features(pa.array([word]), restorer)[1]) <= set(own)


@pytest.mark.parametrize("where", [0, 7, 31, 32, 33, 400])
def test_a_word_anywhere_in_a_long_chain_is_found(restorer, where):
    chain = ["word"] * where + ["m0r0n"] + ["word"] * 40
    own = toxicity.features(pa.array(["-".join(chain)]), restorer)[1]
    assert set(toxicity.features(pa.array(["moron"]), restorer)[1]) <= set(own)


def test_long_tokens_are_restored_too(restorer):
    own = toxicity.features(pa.array(["-".join(["word"] * 30) + "-m0r0n-" + "-".join(["word"] * 30)]), restorer)[1]
    assert set(toxicity.features(pa.array(["moron"]), restorer)[1]) <= set(own)


def test_obfuscated_toxicity_is_caught(spark, table_of, words, restorer):
    """Documents of clean words with a few of the labels' toxic ones, plain and disguised."""
    clean = [" ".join(words[i : i + 60]) for i in range(0, 2400, 60)]
    disguised = [f"{t} m0r0n {t} $tupid l o s e r {t} traaaash" for t in clean[:20]]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**7 + i, t) for i, t in enumerate(clean + disguised)], "doc_id long, text string"))
    found = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("doc_id >= 10000000").collect()}
    assert sum(found[10**7 + i] for i in range(40)) == 0
    assert sum(found[10**7 + 40 + i] for i in range(20)) == 20


def test_trigrams_stop_at_borders(spark, table_of):
    found = {r["gram"]: r["n"] for r in toxicity.trigram_counts(table_of([(1, "ab a"), (2, None), (3, "B")])).collect()}
    gram = lambda a, b, c: (a * 28 + b) * 28 + c
    assert found[gram(0, 0, 1)] == 2 and found[gram(0, 1, 2)] == 1 and found[gram(0, 0, 2)] == 1 and found[gram(1, 2, 0)] == 1
