"""Each operator against brute force on small tables, and on nulls, empty and long texts, ties, repeats, no rows, clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.oracle import same
from tidelog.llm import chat_format, decontaminate, exact_dedup, graph, language_id, license_scan, line_dedup, minhash, quality, registry, sentencepiece, suffix_dedup
from tidelog.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
NASTY = [
    (None, "a null id stands here", "en", None, None), (1, None, "en", "s", 0), (2, "", None, "s", 0), (3, "!!! ... 123", "en", "s", 9),
    (4, "one two three four five six seven eight nine ten eleven twelve", "en", "s", 1), (4, "one two three four five six seven eight nine ten eleven twelve", "en", "s", 1),
    (5, "one two three four five six seven eight nine ten eleven twelve", "de", "t", 1), (6, "x" * 70_000 + " " + "word " * 9_000, "en", "s", 1),
    (7, "\n\n\n", "fr", "s", 3), (8, "é😀▁ 中文 \x00\x01 </s>", "fr", "s", 3), (9, "Released under the MIT License.", "en", "s", 1), (-1, "one", "en", "s", 1),
]


def docs(spark, rows=NASTY):
    return spark.createDataFrame(rows, DOCS)


def sample(spark):
    return table(spark, SF, "documents")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    same(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF)


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op")) == list(range(1, 11))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and registry.QUERIES["pipeline"] is corpus_pipeline.run


# Exact dedup


def test_exact_dedup_cases(spark):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs(spark)).collect())
    assert (True, 4, 4, 3, True) in got and (True, 5, 4, 3, False) in got  # repeated rows share an answer
    assert (True, 1, 1, 2, True) in got and (True, 2, 1, 2, False) in got  # null is empty
    largest = {(r.doc_id, r.kept) for r in exact_dedup.exact_dedup(docs(spark), keep="largest").collect()}
    assert (5, True) in largest and (4, False) in largest
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    clash = docs(spark).selectExpr("*", "n_chars AS h1", "lang AS body", "lang AS kept", "text AS keep_id")
    assert exact_dedup.exact_dedup(clash).count() == len(NASTY)
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(docs(spark), keep="any")


def test_native_plans_have_no_python(spark):
    for df in (exact_dedup.exact_dedup(sample(spark)), line_dedup.line_dedup(sample(spark))):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


# Line dedup


def chunks_of(text):
    lines, out, start, before = text.split("\n"), [], 0, 0
    for i, line in enumerate(lines):
        h = int(hashlib.md5(line.encode()).hexdigest()[:8], 16)
        if (h + line_dedup.FACTOR * before) % line_dedup.DIVISOR == 0 or i == len(lines) - 1:
            out.append("\n".join(lines[start : i + 1]))
            start = i + 1
        before = h
    return out


def test_line_dedup_cases(spark):
    block = "\n".join(f"shared line {i}" for i in range(40))
    rows = [(100 + i, f"own {i}\n{block}\nend {i}", "en", "s", 1) for i in range(4)] + NASTY
    got = line_dedup.line_dedup(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    first = {r.doc_id: r for r in got}
    assert first[100].text == rows[0][1]
    seen = set()
    for i in range(4):
        kept = [c for c in chunks_of(rows[i][1]) if not ("\n" in c and c in seen)]
        seen |= {c for c in chunks_of(rows[i][1]) if "\n" in c}
        assert first[100 + i].text == "\n".join(kept)
    assert first[102].n_removed_lines > 30
    assert (first[1].text, first[1].n_lines, first[2].text, first[2].n_lines) == (None, 0, "", 1)
    assert [r.n_removed_lines for r in got if r.doc_id == 4] == [0, 0]
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0
    clash = docs(spark).withColumnsRenamed({"n_chars": "body", "source": "gone", "lang": "n_lines"})
    assert line_dedup.line_dedup(clash).columns == ["doc_id", "text", "gone", "body", "n_lines", "n_removed_lines", "n_chunks", "n_removed_chunks"]


def without_pairs(rows):
    seen, left = set(), {}
    for key, text in rows:
        lines = text.split("\n")
        gone = set()
        for i, pair in enumerate(zip(lines, lines[1:])):
            if pair in seen:
                gone |= {i, i + 1}
            seen.add(pair)
        left[key] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return left


def test_passages_go_whole(spark):
    passage = "\n".join(f"a line of the passage, number {i}" for i in range(3))
    rows = [(i, f"own {i}\n{passage}\nend {i}\n" + "\n".join(f"{i} rest {k}" for k in range(i)), "en", "s", 1) for i in range(20, 30)]
    rows += [(i, "\n".join(f"of {i % 5}: {k}" for k in range(2 + i % 5)), "en", "s", 1) for i in range(40, 60)]  # copies of two to six lines
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed_lines) for r in line_dedup.passage_dedup(docs(spark, rows)).collect()}
    assert got == without_pairs([(r[0], r[1]) for r in rows])
    assert all(passage not in got[i][0] and got[i][2] == 3 for i in range(21, 30)) and all(got[i][0] == "" for i in range(45, 60))
    assert any(r.text for r in line_dedup.line_dedup(docs(spark, rows)).collect() if r.doc_id >= 45)  # chunks leave scraps


def test_passages_are_brute_force(spark):
    rows = sorted((r.doc_id, r.text) for r in sample(spark).collect())
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed_lines) for r in line_dedup.passage_dedup(sample(spark)).collect()}
    assert got == without_pairs(rows) and sum(x[2] for x in got.values())
    got = line_dedup.passage_dedup(docs(spark)).collect()
    assert len(got) == len(NASTY) and {r.text for r in got if r.doc_id == 1} == {None} and [r.n_removed_lines for r in got if r.doc_id == 4] == [0, 0]
    assert [(r.text, r.n_lines, r.n_removed_lines) for r in got if r.doc_id == 7] == [("", 4, 3)]
    assert line_dedup.passage_dedup(docs(spark, [])).count() == 0
    assert not re.search("Python|Arrow|Pandas", line_dedup.passage_dedup(sample(spark))._jdf.queryExecution().executedPlan().toString())


# Decontamination


def windows(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contaminated(doc_rows, items):
    index = {}
    for name, text in items:
        w = windows(text)
        for s in range(max(1, len(w) - 9) if w else 0):
            index.setdefault(tuple(w[s : s + 10]), set()).add(name)
    out = []
    for d in doc_rows:
        w, names = windows(d), set()
        hit = [False] * len(w)
        for size in {len(k) for k in index}:
            for s in range(len(w) - size + 1):
                if (k := tuple(w[s : s + size])) in index:
                    names |= index[k]
                    hit[s : s + size] = [True] * size
        out.append((len(w), sum(hit), sorted(names)))
    return out


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 700])
def test_decontamination_is_brute_force(spark, block):
    bench = table(spark, SF, "benchmark")
    rows = sample(spark).collect()
    want = {r.doc_id: w for r, w in zip(rows, contaminated([r.text for r in rows], [(str(r.item_id), r.text) for r in bench.collect()]))}
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.find_contamination(sample(spark), bench, block_bytes=block).collect()}
    assert got == want and any(w[1] for w in want.values())


def test_decontamination_cases(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 50)  # only for direct calls; workers keep theirs
    items = spark.createDataFrame([(1, "three four Five"), (1, "word " * 30), (2, None), (None, "eleven twelve"), (3, "..."), (10, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    want = Counter(map(repr, contaminated([r[1] for r in NASTY], [("1", "three four Five"), ("1", "word " * 30), ("", "eleven twelve"), ("10", "one two three four five six seven eight nine ten eleven twelve")])))
    got = Counter(repr((r.n_words, r.n_hit, list(r["items"]))) for r in decontaminate.find_contamination(docs(spark), items).collect())
    assert got == want
    assert decontaminate.find_contamination(docs(spark), items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.find_contamination(docs(spark, []), items).count() == 0
    kept = decontaminate.remove_contaminated(docs(spark), items)
    assert kept.columns == docs(spark).columns and sorted(r.doc_id or 0 for r in kept.collect()) == [-1, 0, 1, 2, 3, 7, 8, 9]
    tests = decontaminate.test_suffixes([("a", b"a b c d e f g h i j k l")])
    words = decontaminate.numbered(b"x " * 45 + b"a b c d e f g h i j k l " * 3, tests.vocabulary)
    at, which, longest = decontaminate.matches(words, tests)
    assert sorted(at.tolist()) == [45, 46, 47, 57, 58, 59, 69, 70, 71] and longest.max() == 12


def test_longest_match_of_items_that_begin_alike(spark):
    prompt = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, prompt + " a much longer tail than that"), (2, prompt + " short tail"), (3, prompt + " short tail of three")], "item_id long, text string")
    rows = [(1, "before " + prompt + " short tail behind", "en", "s", 1), (2, prompt + " a much other", "en", "s", 1), (3, prompt, "en", "s", 1)]
    got = {r.doc_id: (r.n_hit, list(r["items"]), r.longest_match) for r in decontaminate.find_contamination(docs(spark, rows), items).collect()}
    assert got == {1: (12, ["1", "2", "3"], 12), 2: (12, ["1", "2", "3"], 12), 3: (10, ["1", "2", "3"], 10)}


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 40])
def test_repeated_rows_are_answered_each(spark, block):
    rows = [(1, "one two three four", "en", "s", 1)] * 3 + [(None, "one two three four", "en", "s", 1)] * 2 + [(None, None, "en", "s", 1)] * 2 + [(2, "none", "en", "s", 1)]
    clash = docs(spark, rows).withColumnsRenamed({"lang": "doc_key", "source": "spans", "n_chars": "items"})
    items = spark.createDataFrame([(i, f"two three f{'o' * i}ur and something longer than that") for i in range(9)] + [(50, "two three")], "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.longest_match) for r in decontaminate.find_contamination(clash, items, block_bytes=block).collect())
    assert got == {(1, 4, 2, 2): 3, (None, 4, 2, 2): 2, (None, 0, 0, 0): 2, (2, 1, 0, 0): 1}


def longest(text, items, window=10):
    """The most words that a text shares with a suffix of an item, by trying all pairs of places."""
    w, best = windows(text), 0
    for item in map(windows, items):
        for t in range(max(1, len(item) - window + 1) if item else 0):
            least = min(window, len(item))
            for p in range(len(w) - least + 1):
                n = 0
                while p + n < len(w) and t + n < len(item) and w[p + n] == item[t + n]:
                    n += 1
                best = max(best, n) if n >= least else best
    return best


def test_longest_match_is_brute_force(spark):
    rng = random.Random(11)
    words = lambda n, kinds: " ".join(rng.choice("abcdefgh"[:kinds]) for _ in range(n))
    items = [words(rng.randrange(1, 60), 2) for _ in range(20)] + ["a " * 90, "a b " * 40, words(8, 4), words(4, 3)]
    rows = [(i, words(rng.randrange(80), 2) + " x " + rng.choice(items)[rng.randrange(8) :] + " " + words(9, 4), "en", "s", 1) for i in range(60)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: r.longest_match for r in decontaminate.find_contamination(docs(spark, rows), bench).collect()}
    assert got == {r[0]: longest(r[1], items) for r in rows} and max(got.values()) > 40


def test_long_items_need_room_as_they_are_long(spark):
    import pickle
    import tracemalloc

    rng = random.Random(12)
    long, same = " ".join(f"w{rng.randrange(5000)}" for _ in range(20_000)), "same " * 20_000
    tracemalloc.start()
    tests = decontaminate.test_suffixes([("a", long.encode()), ("b", same.encode())])
    heads = tests.heads()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 << 20 and len(pickle.dumps(tests)) < 4 << 20 and len(heads) == 19_992
    bench = spark.createDataFrame([(1, long), (2, same)], "item_id long, text string")
    rows = [(1, "before " + long + " behind", "en", "s", 1), (2, same, "en", "s", 1), (3, "same " * 9, "en", "s", 1), (4, " ".join(long.split()[5:40]), "en", "s", 1)]
    got = {r.doc_id: (r.n_hit, list(r["items"]), r.longest_match) for r in decontaminate.find_contamination(docs(spark, rows), bench).collect()}
    assert got == {1: (20_000, ["1"], 20_000), 2: (20_000, ["2"], 20_000), 3: (0, [], 0), 4: (35, ["1"], 35)}


# Language


def test_language_held_out(spark):
    rows = {r.doc_id: r for r in registry.QUERIES["op4_language_id"](spark, SF).collect()}
    truth = {r.doc_id: r.lang for r in sample(spark).collect()}
    held = [i for i, r in rows.items() if r.held_out]
    assert sum(rows[i].lang_pred == truth[i] for i in held) >= 0.95 * len(held)
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows.values())
    assert {r.held_out for r in language_id.identify(docs(spark).where("doc_id IS NULL"), None).collect()} == {False}
    assert not any(r.rejected for r in rows.values())


def test_language_cases(spark):
    model = language_id.learn(sample(spark))
    rows = NASTY + [(20, "Это русский текст о погоде и природе, в нём много слов.", None, "s", 1), (21, "zxqj vkwq xzzq jjkq wqxz qqvk zxjq kkwx qxzj vvqx " * 3, "en", "s", 1)]
    got = [(r.doc_id, r.lang_pred, r.score, r.rejected) for r in language_id.identify(docs(spark, rows), model).collect()]
    assert len(got) == len(rows)
    by = {g[0]: g for g in got}
    for blank in (1, 2, 3, 7):
        assert by[blank][1:] == ("und", 0.0, True)
    assert by[20][3] and by[21][3]
    clash = docs(spark, rows).withColumnsRenamed({"lang": "bits", "source": "doc_key", "n_chars": "lang_pred"})
    key = lambda r: (r.doc_id is None, r.doc_id, r.score)
    assert [r.lang_pred for r in sorted(language_id.identify(clash, model).collect(), key=key)] == [r.lang_pred for r in sorted(language_id.identify(docs(spark, rows), model).collect(), key=key)]
    assert language_id.learn(docs(spark, [])) is None
    assert {r.lang_pred for r in language_id.identify(docs(spark), None).collect()} == {"und"}
    one = language_id.learn(docs(spark, [(i, "only one language here", "en", "s", 1) for i in range(9)]))
    assert {r.lang_pred for r in language_id.identify(docs(spark, [(1, "anything", None, None, 1)]), one).collect()} == {"en"}


@pytest.mark.parametrize("most", [0, 2_000, 9_000])
def test_language_tables_are_the_models(spark, most):
    rows = sample(spark).select("doc_id", "text", "lang", "source", "n_chars").where("doc_id % 2 = 0 OR text IS NULL").unionAll(docs(spark))
    held, tables = language_id.learn(rows), language_id.learn(rows, most)
    assert held.tables is None and tables.tables is not None and tables.models == [] and len(tables.known.values) * len(tables.langs) <= most
    assert tables.langs == held.langs and tables.mean == pytest.approx(held.mean, rel=1e-5) and tables.limit == pytest.approx(held.limit, rel=1e-3)
    key = lambda r: (r.doc_id is None, r.doc_id, r.doc_key)
    want, got = (sorted(language_id.identify(rows, x).collect(), key=key) for x in (held, tables))
    assert [(r.doc_id, r.doc_key, r.held_out, r.lang_pred, r.rejected) for r in got] == [(r.doc_id, r.doc_key, r.held_out, r.lang_pred, r.rejected) for r in want]
    for a, b in zip(got, want, strict=True):
        assert a.score == pytest.approx(b.score, abs=1e-5) and (a.bits is None) == (b.bits is None) and (a.bits is None or a.bits == pytest.approx(b.bits, rel=1e-5))


def test_model_is_a_distribution():
    keys, n = language_id.np.unique(language_id.grams(["the cat sat on the mat", "then the rat"])[0], return_counts=True)
    model = language_id.Model.fit(keys, n.astype(float))
    letters = [0, *map(ord, "abcdefghijklmnopqrstuvwxyz")]
    seen = sorted({int(k) & 0xFFFF for k in keys})
    context = (ord("t") << 16 | ord("h")) << 16
    context = (0 << 48) | (ord("t") << 32) | (ord("h") << 16)
    total = model.prob(language_id.np.array([context | c for c in seen], language_id.np.uint64)).sum()
    assert 0.9 < total <= 1.0001 and set(seen) <= set(letters)


def kneser_ney(texts):
    """Interpolated Kneser-Ney of order 4 by the definition: probability of a character after up to three others."""
    order, counts = language_id.ORDER, [Counter() for _ in range(language_id.ORDER)]
    for text in texts:
        line = " " * (order - 1) + re.sub("[^a-z]+", " ", text.lower()).lstrip(" ")
        for i in range(order - 1, len(line)):
            counts[-1][line[i - order + 1 : i + 1]] += 1
    for n in range(order - 1, 0, -1):  # in how many contexts of one character more each shorter n-gram stands
        for gram in counts[n]:
            counts[n - 1][gram[1:]] += 1

    def prob(gram):
        if not gram:
            return 1 / (len(counts[0]) + 1)
        own = counts[len(gram) - 1]
        n1, n2 = (sum(1 for c in own.values() if c == k) for k in (1, 2))
        cut = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.1
        beside = [c for g, c in own.items() if g[:-1] == gram[:-1]]
        if not beside:
            return prob(gram[1:])
        return max(own[gram] - cut, 0) / sum(beside) + cut * len(beside) / sum(beside) * prob(gram[1:])

    return prob


def test_model_is_kneser_ney(spark):
    rows = [r.text for r in sample(spark).collect() if r.lang == "en" and r.text and r.text.isascii()][:60]
    texts = [x[:400] for x in rows if x]
    keys, n = language_id.np.unique(language_id.grams(texts)[0], return_counts=True)
    model, prob, rng = language_id.Model.fit(keys, n.astype(float)), kneser_ney(texts), random.Random(2)
    grams = {"".join(rng.choice(" abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(60)} | {texts[i % len(texts)].lower()[i : i + 4] for i in range(60)}
    grams = sorted(g for g in grams if re.fullmatch("[a-z ]{4}", g) and "  " not in g)
    code = lambda g: sum((0 if c == " " else ord(c)) << 16 * (3 - i) for i, c in enumerate(g))
    got = model.prob(language_id.np.array([code(g) for g in grams], language_id.np.uint64))
    assert len(grams) > 60 and got.tolist() == pytest.approx([prob(g) for g in grams], rel=1e-4)


# Quality


def test_ranking_is_the_least_loss_of_pairs():
    """The gradient of the pairs' logistic loss is zero at the weights, and better documents lie higher."""
    np, rng = quality.np, quality.np.random.default_rng(1)
    rows = rng.random((400, len(quality.FEATURES) + quality.KINDS))
    labels = (rows[:, 0] + rows[:, 3] * 0.5 + rng.normal(0, 0.3, 400) > 0.75).astype(int)
    found = quality.rank(rows, labels, pairs=20_000)
    x = quality.standard(rows, found.mean, found.scale)
    draw = np.random.default_rng(5)
    won, lost = draw.choice(np.flatnonzero(labels == 1), 20_000), draw.choice(np.flatnonzero(labels == 0), 20_000)
    d = x[won] - x[lost]
    gradient = (d * (1 / (1 + np.exp(d @ found.weights)))[:, None]).mean(0) - 1e-3 * found.weights
    assert np.abs(gradient).max() < 1e-3
    raw = x @ found.weights
    right = (raw[won] > raw[lost]).mean()
    assert right > 0.8 and found.cut == pytest.approx(np.quantile(raw, (labels == 0).mean()))
    scores = found.score(rows)
    assert ((scores >= quality.CUT) == (raw >= found.cut)).mean() > 0.99 and (np.argsort(scores, kind="stable") == np.argsort(raw, kind="stable")).mean() > 0.9


def test_quality_held_out(spark):
    got = {r.doc_id: r for r in registry.QUERIES["op5_quality"](spark, "/root/testdata/sf0.01").collect()}
    truth = {r.doc_id: r.quality for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    held = [i for i in truth if got[i].held_out]
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_quality_cases(spark):
    labels = spark.createDataFrame([(4, 1, None), (5, 0, 1), (4, None, 0), (None, 1, 1), (77, 0, 0)], "doc_id long, quality int, toxic int")
    ranking = quality.learn(docs(spark), labels)
    got = quality.score(docs(spark), ranking).collect()
    assert len(got) == len(NASTY) and all(math.isfinite(r.score) for r in got) and [r.held_out for r in got if r.doc_id is None] == [False]
    clash = docs(spark).withColumnsRenamed({"lang": "score", "source": "features", "n_chars": "quality"})
    assert sorted((r.doc_id or 0, r.score) for r in quality.score(clash, ranking).collect()) == sorted((r.doc_id or 0, r.score) for r in got)
    assert {r.score for r in quality.score(docs(spark), None).collect()} == {0.5}
    assert quality.learn(docs(spark), labels.limit(0)) is None and quality.score(docs(spark, []), ranking).count() == 0


# Near-duplicates


def shingles(text):
    w = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(rows, percent):
    sets, parent = {}, {}
    for i, text in rows:
        if i is not None:
            sets.setdefault(i, shingles(text))
            parent[i] = i

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def family(seed=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(900)}" for _ in range(80)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(80)] = f"n{rng.randrange(9999)}"
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize(("percent", "cell"), [(85, minhash.CELL_SHINGLES), (80, 500)])
def test_near_duplicates_are_brute_force(spark, percent, cell):
    rows = [*family(), *[(r[0] + 1000 if r[0] is not None else None, r[1]) for r in NASTY], *[(r.doc_id + 5000, r.text) for r in sample(spark).collect()]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash.near_duplicates(df, percent=percent, cell_shingles=cell).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found if r.doc_id is not None} == components(rows, percent)
    assert [(r.component_id, r.kept) for r in found if r.doc_id is None] == [(None, False)]


def by_rows(rows, percent):
    """component_id of each id, where all texts of an id are one node: by comparing all pairs of sets."""
    root = {i: i for i, _ in rows}
    sets = [(i, shingles(t)) for i, t in rows]
    edges = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if a & b and 100 * len(a & b) >= percent * len(a | b)]
    for _ in rows:
        for i, j in edges:
            root[i] = root[j] = min(root[i], root[j])
    return root


def test_ids_of_several_texts_have_the_links_of_all(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(f"v{rng.randrange(500)}" for _ in range(n))
    a, b, c, d = (words(60) for _ in range(4))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (9, c), (8, c), (9, d), (7, d + " more"), (6, words(50)), (6, words(50)), (1, a), (4, a), (4, c), (5, "")]
    want = by_rows(rows, 85)
    assert want[3] == 1 and want[7] == 1
    for seed in range(3):
        rng.shuffle(rows)
        frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS node", "1 AS family", "2 AS component_id")
        for cell in (minhash.CELL_SHINGLES, 60):
            got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame, percent=85, cell_shingles=cell).collect())
            assert got == sorted((i, len(shingles(t)), want[i], want[i] == i) for i, t in rows)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    assert {(r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, [(1, None, "", "", 0), (2, " ", "", "", 0)])).collect()} == {(1, True), (2, True)}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "u long, v long")
    assert {r.node: r.root for r in graph.components(edges).collect()} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# Chat


def test_chat_cases(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 1, "user", "a"), (2, 0, "assistant", "x"), (None, None, None, "[INST]"), (3, 0, "user", "[\\\\INST] [/OUT] <\\s> \\"), (3, 1, "assistant", "</s>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as segment", "true as loss")
    segments = chat_format.chat_segments(df)
    got = {r.conv_id: r for r in chat_format.read_back(segments).collect()}
    assert {k: (r.n_turns, r.valid, r.loss_chars) for k, r in got.items()} == {1: (3, False, 1), 2: (1, False, 1), None: (1, False, 0), 3: (2, True, 4)}
    want = hashlib.sha256("user\n[\\\\INST] [/OUT] <\\s> \\\nassistant\n</s>\n".encode()).hexdigest()
    assert got[3].turns_sha256 == want and got[3].loss_sha256 == hashlib.sha256(b"</s>").hexdigest()
    text = {r.conv_id: r.text for r in chat_format.formatted(segments).collect()}[3]
    assert text.count("</s>") == 1 and text.count("[INST]") == 1 and len(text) == got[3].formatted_chars
    assert chat_format.read_back(chat_format.chat_segments(df.limit(0))).count() == 0


def test_text_is_read_by_marks_alone(spark):
    template, rng = chat_format.Template(), random.Random(8)
    parts = ["[INST]", "</s>", " ", "\n", "\\", "a", "[/TURN]", "[", " [/INST]", "[OUT] "]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "[OUT]\\\n", "a\\n"]), "".join(rng.choice(parts) for _ in range(rng.randrange(7)))) for c in range(40) for t in range(rng.randrange(1, 6))]
    segments = chat_format.chat_segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for whole in chat_format.formatted(segments).collect():
        reader, got = chat_format.Reader(template), []
        while whole.text:
            cut = rng.randrange(1, 9)
            piece, whole = whole.text[:cut], type(whole)(conv_id=whole.conv_id, text=whole.text[cut:])
            got += [(role, chat_format.unescape(body)) for role, body in reader.turns(piece)]
        reader.ended()
        assert got == [(r[2], r[3]) for r in rows if r[0] == whole.conv_id]
    blind = segments.withColumns({"part": F.lit("?"), "role": F.lit("?"), "turn": F.lit(0).cast("long")})
    assert sorted(map(tuple, chat_format.read_back(blind).collect())) == sorted(map(tuple, chat_format.read_back(segments).collect()))
    for broken in (segments.where("part <> 'open'"), segments.where("part <> 'close'"), segments.withColumn("text", F.expr("replace(text, '[', '(')"))):
        with pytest.raises(Exception, match="no turn begins|ends within a turn"):
            chat_format.read_back(broken).collect()


def test_long_conversations_and_texts(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(30_000)] + [(2, 0, "user", "[INST] " * 200_000), (2, 1, "assistant", "x</s>" * 200_000)]
    got = {r.conv_id: (r.n_turns, r.loss_chars, r.valid) for r in chat_format.read_back(chat_format.chat_segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got == {1: (30_000, sum(len(r[3]) for r in rows if r[0] == 1 and r[2] == "assistant"), True), 2: (2, 1_000_000, True)}


def test_escapes_are_reversible():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["[", "INST", "]", "/", "\\", "<", "s>", "/s>", "OUT]", "a"]) for _ in range(rng.randrange(9)))
        assert chat_format.unescape(chat_format.escape(text)) == text
        assert not re.search(r"</?s>|\[/?(SYS|INST|OUT|TURN)\]", chat_format.escape(text))
        name = "".join(rng.choice(["\n", "\\", "n", "[", "INST]", "/", "a"]) for _ in range(rng.randrange(8)))
        assert chat_format.unescape_name(chat_format.escape_name(name)) == name and "\n" not in chat_format.escape_name(name)


# Pieces


def test_pieces_are_the_librarys(spark):
    spm = pytest.importorskip("sentencepiece")
    raw = sentencepiece.read_model()
    pieces, library = sentencepiece.Pieces.parse(raw), spm.SentencePieceProcessor(model_proto=raw)
    rng = random.Random(2)
    texts = [r.text for r in sample(spark).limit(40).collect()] + [r[1] or "" for r in NASTY]
    texts += ["".join(rng.choice("ab the  in▁\n\té😀\x00ション    0123.,") for _ in range(rng.randrange(60))) for _ in range(500)]
    for t in texts:
        ids = pieces.encode(t)
        assert ids == library.encode(t)
        assert "▁" in t or pieces.decode(ids) == t
    long = "".join(rng.choice("etaoinshr") for _ in range(5000))
    assert list(pieces._numbers(pieces.search("▁" + long))) == library.encode(long)


def test_search_is_merging():
    """Without the library: what the search finds is what merging leaves."""
    pieces, rng = sentencepiece.Pieces.parse(sentencepiece.read_model()), random.Random(4)
    words = {w for r in NASTY if r[1] for w in r[1][:500].split()} | {"".join(rng.choice("etaoinshrdlu0123é中😀▁") for _ in range(rng.randrange(1, 14))) for _ in range(1500)}
    for word in words:
        word = "▁" + word
        assert list(pieces.search(word)) == pieces.merged(word)
    for text in ("abc" * 60, "in" * 100, "the" * 70 + "▁" * 40 + "x" * 50):
        assert list(pieces.search(iter(text))) == pieces.merged(text)


def test_unigram_rule_is_viterbi():
    pieces = sentencepiece.Pieces(["<unk>", "a", "b", "ab", "ba", "bab", "▁"], [0.0, -1.5, -1.25, -2.0, -2.25, -3.125, -0.5], [2, 1, 1, 1, 1, 1, 1], sentencepiece.UNIGRAM, False, False)
    pieces.ids = {t: i for i, t in enumerate(pieces.texts) if i}
    score = lambda way: sum(pieces.scores[pieces.ids[p]] for p in way)

    def ways(text):
        if not text:
            yield []
        for n in range(1, 4):
            if text[:n] in pieces.ids and len(text) >= n:
                for rest in ways(text[n:]):
                    yield [text[:n], *rest]

    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice("ab▁") for _ in range(rng.randrange(1, 12)))
        found = list(pieces.search(text))
        assert "".join(found) == text and math.isclose(score(found), max(map(score, ways(text))))
    assert "".join(pieces.search("ab" * 4000)) == "ab" * 4000


def test_pieces_cases(spark):
    raw = sentencepiece.read_model()
    rows = sentencepiece.round_trip(docs(spark), raw).collect()
    assert len(rows) == len(NASTY) and [r.exact for r in rows if r.doc_id == 8] == [False]
    assert all(r.exact for r in rows if r.doc_id != 8) and {r.n_ids for r in rows if r.doc_id in (1, 2)} == {0}
    encoded = sentencepiece.encode(docs(spark), raw)
    assert Counter(r.text for r in sentencepiece.decode(encoded, raw).collect() if r.doc_id != 8) == Counter(r[1] or "" for r in NASTY if r[0] != 8)
    assert sentencepiece.round_trip(docs(spark, []), raw).count() == 0
    clash = docs(spark).withColumnsRenamed({"lang": "ids", "source": "exact", "n_chars": "n_ids"})
    ids = sorted((r.doc_id or 0, list(r.ids)) for r in sentencepiece.round_trip(clash, raw, with_ids=True).collect())
    assert ids == sorted((r.doc_id or 0, list(r.ids)) for r in encoded.collect())


# Suffix arrays


def planted(seed=6):
    rng = random.Random(seed)
    words = lambda n: "".join(rng.choice("abcdefé fgh") for _ in range(n))
    shared = words(450)
    texts = [words(rng.randrange(400)) + shared[rng.randrange(200) : rng.randrange(200, 450)] + words(rng.randrange(300)) for _ in range(25)]
    for period in (1, 3, 40, 149, 151, 152, 260):
        unit = words(period)
        texts += [words(rng.randrange(200)) + (unit * 2000)[:n] + words(9) for n in (199, 203, 230, 420, 1500)]
    return [*texts, *[r[1] for r in NASTY], "the " * 300, "the " * 60]


@pytest.mark.parametrize("cell", [suffix_dedup.CELL, 2])
def test_suffix_dedup_is_brute_force(spark, cell):
    texts = planted()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = suffix_dedup.brute_force([(t or "").encode() for t in texts])
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digest(suffix_dedup.remove_repeats(df, cell=cell)).collect()}
    assert [got[i] for i in range(len(texts))] == want and sum(w[1] > 0 for w in want) > 20


def test_suffix_dedup_cases(spark):
    rows = suffix_dedup.remove_repeats(docs(spark, [(None, "q" * 250, "", "", 0), (1, "r" * 199, "", "", 0), (2, None, "", "", 0)])).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in rows) == [(0, 0), (199, 0), (250, 250)]
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0


@pytest.mark.parametrize("cell", [suffix_dedup.CELL, 20])
def test_rows_that_repeat_a_document(spark, cell):
    rng = random.Random(3)
    words = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    text, part = words(3000), words(260)
    rows = [(None, text)] * 3000 + [(7, part + words(90))] * 40 + [(8, words(90) + part)] + [(9, words(150))] * 30
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS at", "'x' AS anchor", "2 AS spans", "3 AS doc_key").repartition(4)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(frame, cell=cell).collect())
    assert got == {(None, 3000, 3000, 1): 3000, (7, 350, 350, 1): 40, (8, 350, 260, 1): 1, (9, 150, 0, 0): 30}


def repeats(texts, length):
    """Maximal repeats by trying all pairs of places: bytes -> places. None is both left- and right-extendable alike in all of its places."""
    found = set()
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[: i + 1]):
            for x in range(len(a)):
                for y in range(len(b) if i != j else x):
                    if x and y and a[x - 1] == b[y - 1]:
                        continue
                    n = 0
                    while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                        n += 1
                    if n >= length:
                        found.add(a[x : x + n])
    return {f: {(i, x) for i, t in enumerate(texts) for x in range(len(t) - len(f) + 1) if t[x : x + len(f)] == f} for f in found}


def test_groups_are_the_maximal_repeats(spark):
    rng = random.Random(21)
    words = lambda n: bytes(rng.choice(b"abcd") for _ in range(n))
    one, two = words(26), words(24)
    texts = [words(9) + one[rng.randrange(6) : rng.randrange(20, 27)] + words(5) + two[rng.randrange(4) :] + words(4) for _ in range(12)] + [one + two, one + two, one]
    want = {hashlib.blake2b(f, digest_size=16).hexdigest(): (len(f), places) for f, places in repeats(texts, 12).items()}
    frame = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    # windows of 12 bytes are what must be found, so a repeat of up to 12 bytes behind and 8 before its anchor is seen whole
    got = {}
    for r in suffix_dedup.repeat_groups(frame, length=12, gram=4).collect():
        got.setdefault((r.repeat, r.length, r.cut), set()).add((r.doc_id, r.start))
    whole = {k: (n, places) for (k, n, cut), places in got.items() if not cut}
    assert whole and all(want[k] == found for k, found in whole.items())
    assert all(len(places) > 1 and {texts[i][x : x + n] for i, x in places} and len({texts[i][x : x + n] for i, x in places}) == 1 for (_, n, _), places in got.items())
    for k, (n, places) in want.items():  # one that is longer comes in parts that cover it
        if k not in whole:
            for i, x in places:
                hit = {y for (_, m, cut), own in got.items() for (j, s) in own if j == i for y in range(s, s + m)}
                assert hit >= set(range(x, x + n))
    spans = {(r.doc_id, y) for r in suffix_dedup.remove_repeats(frame, length=12, gram=4).collect() for x in r.spans for y in range(x.start, x.stop)}
    assert spans == {(i, y) for (_, n, _), own in got.items() for i, x in own for y in range(x, x + n)}
    windows = suffix_dedup.repeat_groups(frame, length=12, gram=4, cell=1)
    assert {(r.doc_id, y) for r in windows.collect() for y in range(r.start, r.start + r.length)} == {(i, y) for (_, n, _), own in got.items() for i, x in own for y in range(x, x + n)}


def test_long_documents_are_cut_for_hashing(spark):
    rng = random.Random(9)
    own = "".join(rng.choice("abcdefghij ") for _ in range(1_100_000))
    text = own + own[1_048_000:1_049_000]
    row = suffix_dedup.remove_repeats(docs(spark, [(1, text, "", "", 0)])).first()
    assert (row.n_removed, [(s.start, s.stop) for s in row.spans]) == (2000, [(1_048_000, 1_049_000), (1_100_000, 1_101_000)])


def test_interval_tree():
    import numpy as np

    assert list(suffix_dedup.common_prefix_intervals(np.array([-1, 1, 3, 0, -1, 2]))) == [(3, 1, 2), (1, 0, 2), (0, 0, 3), (2, 4, 5)]


# Licences


def test_license_scan_cases(spark):
    rows = [
        (1, "p/a/x.py", "code " * 50 + "\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "p/a/b/y.py", "nothing"), (3, "p/LICENSE", "Released under the MIT License."),
        (4, "p/z.py", None), (5, None, "x"), (6, "q/w.py", ""), (7, "p/a/LICENSE.txt", "This work is licensed under the GNU General Public License, version 3."), (7, "p/a/LICENSE.txt", "This work is licensed under the GNU General Public License, version 3."),
        (8, "p//c/d/e.py", "plain words only"), (9, "COPYING", "Licensed under CC BY-NC 4.0."), (10, "r/s", "free words"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").selectExpr("*", "1 as cosine", "'x' as directory")
    got = {r.doc_id: (r.own_license, r.license, r.inherited_from, r.distance) for r in license_scan.license_scan(df).collect()}
    assert got == {
        1: ("Apache-2.0", "Apache-2.0", None, None), 2: (None, "GPL-3.0", "p/a", 1), 3: ("MIT", "MIT", None, None), 4: (None, "MIT", "p", 0), 5: (None, None, None, None),
        6: (None, "CC-BY-NC-4.0", "", 1), 7: ("GPL-3.0", "GPL-3.0", None, None), 8: (None, "MIT", "p", 2), 9: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None, None), 10: (None, "CC-BY-NC-4.0", "", 1),
    }
    assert license_scan.license_scan(df.limit(0)).count() == 0


def test_license_scan_finds_every_notice(spark):
    notices = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    got = {r.doc_id: r.own_license for r in registry.QUERIES["op1_license_scan"](spark, "/root/testdata/sf0.01").collect()}
    for r in table(spark, "/root/testdata/sf0.01", "documents").collect():
        want = {n for line, n in notices.items() if line in r.text.split("\n")}
        assert (got[r.doc_id] in want) if want else got[r.doc_id] is None


def test_license_scan_finds_notices_among_words(spark):
    apache, long = license_scan.TEMPLATES["Apache-2.0"]
    want = {
        "Copyright 2021 Acme Inc. Released under the MIT License.": "MIT", "Copyright 2019 The Authors. Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (see LICENSE file in the project root for details).": "Apache-2.0", "Photo by Jane Doe, licensed under CC BY 4.0.": "CC-BY-4.0",
        "MIT License": "MIT", "SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: GPL-3.0-or-later, see below": "GPL-3.0", "ours: SPDX-License-Identifier: LGPL-3.0-only": "LGPL-3.0",
        "some words before " * 30 + long + " and many words behind" * 30: "Apache-2.0", "free words\nbefore it " + long.replace(" ", "\n", 9) + " and\nbehind": "Apache-2.0",
        "Text by us, licensed under CC BY-NC 4.0, all of it": "CC-BY-NC-4.0", "we take part in this work for the public, under the version of a file that you may use": None, "SPDX-License-Identifier: Zlib": None, "": None,
    }
    rows = [(i, f"d{i}/f", text) for i, text in enumerate(want)] + [(100 + i, f"e{i}/f", "plain words of a text, under the sea " * 3) for i in range(300)]
    got = {r.doc_id: r.own_license for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values()) and {got[100 + i] for i in range(300)} == {None}


def tf_idf(texts):
    """Cosine of two lists of words by the definition, over the documents ``texts``."""
    often = Counter(t for x in texts for t in set(re.findall("[a-z0-9]+", x.lower())))

    def weighed(words):
        return {t: n * (math.log((1 + len(texts)) / (1 + often[t])) + 1) for t, n in Counter(words).items()}

    def cosine(a, b):
        a, b = weighed(a), weighed(b)
        norm = math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))
        return sum(w * b.get(t, 0) for t, w in a.items()) / norm if norm else 0.0

    return cosine


def test_license_cosines_are_brute_force(spark):
    templates = license_scan.both(license_scan.TEMPLATES, license_scan.full_texts())
    texts = [r.text or "" for r in sample(spark).collect()] + ["MIT", "Apache\n\nLicense", "a\nb the\n\nof any license version", *(x for own in templates.values() for x in own[:1])]
    cosine, words = tf_idf(texts), lambda x: re.findall("[a-z0-9]+", x.lower())
    forms = [(name, words(x)) for name, own in sorted(templates.items()) for x in own]
    documents, often = license_scan._term_counts(spark.createDataFrame([(x,) for x in texts], "text string"), frozenset(t for _, x in forms for t in x), 0.0)
    assert documents == len(texts) and often == Counter(t for x in texts for t in set(words(x)))
    scanner = license_scan.Scanner(templates, documents, often)
    for text in texts:
        units = [words(x) for x in text.split("\n")] + [words(x) for x in re.split(r"\n[^a-zA-Z0-9\n]*\n", text)] + [words(text)]
        want = max(cosine(u, f) for u in units for _, f in forms)
        got, name, _ = scanner.scan(text, 0.7)
        if want >= 0.7:
            assert got >= want - 1e-9 and name
        else:
            assert got == pytest.approx(want) or got >= 0.7  # a window within a paragraph


def test_whole_licence_texts_are_told_apart(spark):
    texts = license_scan.full_texts()
    assert {"BSD-2-Clause", "BSD-3-Clause", "ISC", "MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "Unlicense"} <= set(texts)
    changed = lambda x: x.replace("Copyright (c)", "Copyright (c) 1998-2020 Some Body and others. All rights reserved.")
    rows = [(i, f"{name}/LICENSE", "A project of ours\n\n" + changed(x)) for i, (name, (x,)) in enumerate(texts.items())] + [(100 + i, f"{name}/src/a.c", "int main") for i, name in enumerate(texts)]
    rows += [(200, "x/LICENSE", "\n".join(texts["Apache-2.0"][0].split("\n")[:6])), (300, "x/y/z", None)] + [(1000 + i, f"z/{i}", "plain words of a text, under the sea, for any use of the software " * 3) for i in range(300)]
    got = {r.doc_id: (r.license, r.inherited_from) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    for i, name in enumerate(texts):
        assert got[i] == (name, None) and got[100 + i] == (name, name)
    assert got[200] == ("Apache-2.0", None) and got[300] == ("Apache-2.0", "x") and {got[1000 + i] for i in range(300)} == {(None, None)}


def test_license_of_a_long_text(spark):
    rows = [(1, "a/b", "free words of no licence " * 40_000 + "\n\nReleased under the MIT License.\n" + "more words " * 40_000), (2, "a/c", None)]
    got = {r.doc_id: (r.own_license, r.license) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "MIT"), 2: (None, None)}


# Pipeline


def test_pipeline_is_its_stages_by_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in sorted(sample(spark).collect(), key=lambda r: r.doc_id)]
    kept, seen = [], set()
    for i, text in rows:  # nothing here is rejected; later copies of a chunk go
        parts = chunks_of(text)
        left = [c for c in parts if not ("\n" in c and c in seen)]
        for c in [c for k, c in enumerate(parts) if "\n" in c]:
            seen.add(c)
        if len(parts) == len(left) or "\n".join(left):
            kept.append((i, "\n".join(left)))
    near = components(kept, 80)
    kept = [(i, t) for i, t in kept if near[i][2]]
    items = [(str(r.item_id), r.text) for r in table(spark, SF, "benchmark").collect() if len(windows(r.text)) >= 10]
    kept = [(i, t) for (i, t), found in zip(kept, contaminated([t for _, t in kept], items)) if not found[1]]
    pieces = sentencepiece.Pieces.parse(sentencepiece.read_model())
    got = {r.doc_id: (r.n_ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {i: (len(pieces.encode(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in kept}


def test_passages_pipeline_is_its_stages_by_brute_force(spark):
    left = without_pairs(sorted((r.doc_id, r.text) for r in sample(spark).collect()))
    kept = [(i, t) for i, (t, _, n) in left.items() if not n or t]
    near = components(kept, 80)
    kept = [(i, t) for i, t in kept if near[i][2]]
    items = [(str(r.item_id), r.text) for r in table(spark, SF, "benchmark").collect() if len(windows(r.text)) >= 10]
    kept = [(i, t) for (i, t), found in zip(kept, contaminated([t for _, t in kept], items)) if not found[1]]
    pieces = sentencepiece.Pieces.parse(sentencepiece.read_model())
    got = {r.doc_id: (r.n_ids, r.decoded_sha256) for r in registry.QUERIES["pipeline_passages"](spark, SF).collect()}
    assert got == {i: (len(pieces.encode(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in kept}


def test_pipeline_gives_ids_and_leaves_one_table(spark):
    import os

    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared)) if os.path.exists(shared) else set()
    result = corpus_pipeline.run(spark, SF)
    assert [os.listdir(f"{shared}/{x}") for x in set(os.listdir(shared)) - before] == [[corpus_pipeline.STAGES[-2][0]]]
    pieces = sentencepiece.Pieces.parse(sentencepiece.read_model())
    texts = {r.doc_id: r.text for r in sample(spark).collect()}
    for r in result.collect():
        assert len(r.ids) == r.n_ids and hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in r.ids)).hexdigest() == r.ids_sha256
        assert hashlib.sha256(pieces.decode(r.ids).encode()).hexdigest() == r.decoded_sha256 and r.doc_id in texts


def test_copies_of_several_lines_go(spark):
    rows = [(i, "\n".join(f"of {i % 5}: {k}" for k in range(2 + i % 5)), "en", "s", 1) for i in range(20)] + [r for r in NASTY if r[0] and r[0] < 0]
    assert {r.doc_id for r in corpus_pipeline.remove_repeated_passages(spark, docs(spark, rows), SF).collect()} == {-1, 0, 1, 2, 3, 4}
    assert dict(corpus_pipeline.PASSAGE_STAGES)["line_dedup"] is corpus_pipeline.remove_repeated_passages
    now = docs(spark)
    after = corpus_pipeline.remove_repeated_passages(spark, now, SF)
    assert after.columns == now.columns and after.count() == len(NASTY) - 1  # of blank lines alone nothing is left


def test_stages_take_any_documents(spark):
    now = docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SF)
        assert after.columns == now.columns
        after.count()
        assert stage(spark, docs(spark, []), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() == len(NASTY)
