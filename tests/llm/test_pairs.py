"""N-gram Jaccard join, fuzzy lines and the groups they rest on."""

from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hazardlens.llm import fuzzy_lines, jaccard, linking, scratch, words
from hazardlens.session import scratch_scope, shared_root
from tests.llm import reference


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1 \t\n\x0bé😀.", max_size=30)), max_size=6), st.booleans())
@settings(max_examples=200, deadline=None)
def test_words_are_those_of_the_pattern(texts, spaces):
    found = words.split_words(pa.array(texts, pa.string()), words.NOT_SPACE if spaces else words.ALPHANUMERIC, lower=True)
    want = [reference.words(reference.lower(t)) if spaces else reference.alnum(t) for t in texts]
    assert found.counts.tolist() == [len(w) for w in want]
    got = [found.data[a:b].tobytes().decode() for a, b in zip(found.starts, found.ends, strict=True)]
    assert got == [w for ws in want for w in ws]
    by_word = dict(zip(got, found.hashes.tolist(), strict=True))
    assert len(set(by_word.values())) == len(by_word) and [by_word[w] for w in got] == found.hashes.tolist()


def test_hashes_do_not_depend_on_the_slice(monkeypatch):
    text = pa.array([" ".join(f"w{i % 37}" for i in range(500))])
    whole = words.split_words(text).hashes
    monkeypatch.setattr(words, "HASH_BYTES", 50)
    assert (words.split_words(text).hashes == whole).all()


def test_components_match_union_find(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 40)]
    links += [(2000 + i, 2001 + i) for i in range(25)]
    want = reference.components({x for p in links for x in p}, links)
    got = {r["node"]: r["component"] for r in linking.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {n: c for n, c in want.items() if any(n in p and p[0] != p[1] for p in links)}


def test_sets_that_link_meet_in_time():
    """Their first shared n-gram is in the first block of both, early enough for the overlap that they need."""
    rng = np.random.default_rng(3)
    counts = np.where(rng.random(jaccard.SLOTS) < 0.2, 50, 0)
    tried = 0
    for threshold in (30, 40, 63, 80, 90, 100):
        for _ in range(300):
            n = int(rng.integers(1, 400))
            a = rng.integers(0, 2 ** 63, n).astype(np.uint64)
            reach = n * (100 - threshold) // 100 + 2
            drop = int(rng.integers(0, reach))
            b = np.concatenate((a[drop:], rng.integers(0, 2 ** 63, int(rng.integers(0, reach))).astype(np.uint64)))
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if both and 100 * both >= threshold * (len(a) + len(b) - both):
                tried += 1
                x, y = (jaccard.rare_first(s, counts, threshold).tolist() for s in (a, b))
                first = next(g for g in x if g in set(y))
                needed = -(-(len(a) + len(b)) * threshold // (100 + threshold))
                assert min(len(a) - x.index(first), len(b) - y.index(first)) >= needed
    assert tried > 500


@pytest.mark.parametrize(("size", "threshold"), [(3, 40), (5, 80), (1, 100), (2, 63)])
def test_jaccard_at_other_thresholds(documents, texts, size, threshold):
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(documents, size, threshold).collect()}
    assert got == reference.jaccard(texts, size, threshold)


def test_jaccard_columns_of_other_names(documents, texts):
    named = documents.select(F.col("doc_id").alias("k"), F.col("text").alias("body"), F.col("lang").alias("doc_id"))
    want = reference.jaccard(texts)
    kept = jaccard.one_of_each_group(named, id_column="k", text_column="body")
    assert sorted(r["k"] for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_candidates_grow_with_the_documents(spark):
    """Pairs that are let through grow in proportion, not with the square."""
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy("doc_id").limit(4000).select("text").toPandas()
    counts = np.zeros(jaccard.SLOTS, np.int64)
    seen = []
    for upto in (1000, 4000):
        sets = {jaccard.set_digest(s): s for s in jaccard.gram_sets(words.split_words(pa.array(table["text"][:upto]), lower=True), 5) if len(s)}
        counts[:] = np.bincount(np.concatenate(list(sets.values())) & np.uint64(jaccard.SLOTS - 1), minlength=jaccard.SLOTS)
        by_key, pairs = {}, set()
        for name, grams in sets.items():
            for place, gram in enumerate(jaccard.rare_first(grams, counts, 80).tolist()):
                by_key.setdefault(gram, []).append((name, len(grams), place))
        for group in by_key.values():
            for k, (a, n, i) in enumerate(group):
                pairs |= {(min(a, b), max(a, b)) for b, m, j in group[:k] if min(n - i, m - j) * 180 >= (n + m) * 80}
        seen.append(len(pairs))
    assert seen[1] <= 8 * max(seen[0], 50)


def test_jaccard_groups(documents, texts):
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(documents).collect()}
    assert got == reference.jaccard(texts)


def test_jaccard_stage_keeps_one_of_each_group(documents, texts):
    want = reference.jaccard(texts, 5, 80)
    kept = jaccard.one_of_each_group(documents, size=5, threshold=80)
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_jaccard_odd_rows(odd_rows, nothing):
    assert jaccard.jaccard_groups(nothing).count() == 0
    rows = jaccard.jaccard_groups(odd_rows).collect()
    assert len(rows) == 6
    assert [r["component_id"] for r in rows if r["id"] is None and r["n_shingles"]] == [1]
    assert jaccard.one_of_each_group(odd_rows).count() == 6


def test_jaccard_without_pivots_gives_the_same(documents, texts, monkeypatch):
    plain = linking.linked_groups
    monkeypatch.setattr(jaccard, "linked_groups", lambda *a, **b: plain(*a, **b, pivot_rounds=0))
    got = {r["id"]: r["component_id"] for r in jaccard.jaccard_groups(documents).collect()}
    assert got == {i: c for i, (_, c) in reference.jaccard(texts).items()}


@given(st.lists(st.integers(0, 2 ** 63), min_size=1, max_size=60), st.integers(1, 40), st.lists(st.integers(0, 2 ** 63), max_size=200))
@settings(max_examples=200, deadline=None)
def test_sketches_never_count_too_many(grams, keep, more):
    a, b = (np.unique(np.array(x, np.uint64)) for x in (grams, grams[:keep] + more))
    differ = len(np.setxor1d(a, b))
    assert jaccard.apart(jaccard.sketch(a), jaccard.sketch(b)) <= differ
    assert jaccard.apart(jaccard.sketch(a), jaccard.sketch(a)) == 0


def test_unrelated_pairs_never_meet_whole_rows(spark, monkeypatch):
    """Long texts that share a passage passed the bounds under their keys, and their first blocks were joined to each pair."""
    rng = random.Random(6)
    texts = []
    for k in range(40):
        text = [f"w{rng.randrange(10 ** 9)}" for _ in range(900)]
        passage = [f"p{k // 4}x{i}" for i in range(30)]
        texts.append((k, " ".join(text[:400] + passage + text[400:])))
    texts += [(40, texts[0][1] + " other"), (41, texts[1][1] + " words")]
    seen = {}

    def noted(pairs, most, test, label, plain=linking.by_portions):
        seen.setdefault(label, []).append(pairs.count())
        return plain(pairs, most, test, label)

    monkeypatch.setattr(jaccard, "by_portions", noted)
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {r["id"]: r["component_id"] for r in jaccard.jaccard_groups(docs, size=5, threshold=80).collect()}
    assert got == {i: {40: 0, 41: 1}.get(i, i) for i, _ in texts}
    assert sum(seen["likely-pairs"]) > 40 and sum(seen["linked-pairs"]) <= 4, seen


def test_pairs_in_portions_give_the_same(documents, texts, monkeypatch):
    portions = []
    monkeypatch.setattr(linking, "stored", lambda frame, label: portions.append(label) or scratch.stored(frame, label))
    for name in ("SKETCH_PAIRS", "WHOLE_PAIRS"):
        monkeypatch.setattr(jaccard, name, 5)
    for name in ("SKETCH_SHARE", "WHOLE_SHARE"):
        monkeypatch.setattr(jaccard, name, 20)
    got = {r["id"]: r["component_id"] for r in jaccard.jaccard_groups(documents).collect()}
    assert got == {i: c for i, (_, c) in reference.jaccard(texts).items()}
    assert portions.count("likely-pairs") >= 3 and portions.count("linked-pairs") >= 3, portions


def test_nothing_but_the_results_stays(spark, documents):
    """The tables of line dedup stayed for the whole pipeline, and added to the disk of the stages after it."""
    with scratch_scope(spark):
        root = Path(shared_root(spark).removeprefix("file:"))
        before = {p.name for p in root.glob("*")}
        done = [fuzzy_lines.without_repeated_lines(documents), jaccard.one_of_each_group(documents, size=5, threshold=80)]
        left = {p.name.rpartition("-")[0] for p in root.glob("*") if p.name not in before}
        assert left == {"repeated-lines", "jaccard-groups"}, left
        assert done[0].count() == documents.count() and 0 < done[1].count() < documents.count()


def expected_lines(texts):
    """Kept text per document, by the edit distance of all pairs of normalised lines."""
    places = [(i, k, " ".join(reference.alnum(line))) for i, text in texts for k, line in enumerate((text or "").split("\n"))]
    places = [p for p in places if p[2]]
    forms = sorted({form for _, _, form in places})
    long = [k for k, form in enumerate(forms) if len(form.split(" ")) >= fuzzy_lines.LEAST_WORDS]
    links = [(a, b) for a in long for b in long if b < a and
             min(len(forms[a]), len(forms[b])) * 10 >= max(len(forms[a]), len(forms[b])) * 9 and
             len(set(forms[a].split(" ")) & set(forms[b].split(" "))) * 4 >= len(set(forms[a].split(" "))) and
             reference.distance(forms[a], forms[b]) * 10 <= max(len(forms[a]), len(forms[b]))]
    group = reference.components(range(len(forms)), links)
    at = {f: group[k] for k, f in enumerate(forms)}
    kept, gone = set(), set()
    for i, k, form in sorted(places):
        (gone if at[form] in kept else kept).add((i, k) if at[form] in kept else at[form])
    return {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in texts}


def test_lines(documents, texts):
    got = {r["doc_id"]: r["text"] for r in fuzzy_lines.without_repeated_lines(documents).collect()}
    want = expected_lines(texts)
    assert got == want
    assert sum(a != b for (_, a), b in zip(texts, want.values(), strict=True)) > 20


@given(st.text(alphabet="ab é😀", max_size=40), st.text(alphabet="ab é😀", max_size=40), st.integers(0, 40),
       st.integers(0, 40), st.integers(0, 12))
@settings(max_examples=300, deadline=None)
def test_differing_part_keeps_the_edit_distance(a, inserted, at, upto, room):
    for b in (a[:at] + inserted[:3] + a[upto:], inserted):
        found = fuzzy_lines.differing_part(a, b, room)
        want = reference.distance(a, b)
        assert found is not None or want > room
        assert found is None or reference.distance(*found) == want


@given(st.lists(st.sampled_from(["a", "bb", "ccc", "é", "😀d"]), min_size=1, max_size=14), st.integers(0, 14), st.integers(0, 14),
       st.lists(st.sampled_from(["a", "bb", "zz"]), max_size=3))
@settings(max_examples=300, deadline=None)
def test_edits_by_words_are_never_fewer_than_the_fewest(line, at, upto, inserted):
    other = line[:at] + inserted + line[upto:] or ["x"]
    for a, b in ((line, other), (other, line)):
        edits = fuzzy_lines.edits_by_words(" ".join(a), " ".join(b), 1000)
        assert edits >= reference.distance(" ".join(a), " ".join(b)) and (a != b or edits == 0)


def test_near_lines_are_told_by_their_words():
    line = [f"word{k}" for k in range(90)]
    near = line[:20] + ["another"] + line[21:60] + line[61:]
    batch = pa.RecordBatch.from_pydict({"a": [1], "b": [2], "a_line": [" ".join(line)], "b_line": [" ".join(near)]})
    assert fuzzy_lines.differing_parts(batch, 10).to_pylist() == [{"a": 1, "b": 2, "a_part": "", "b_part": "", "room": 61}]


def test_votes_of_many_words():
    rng = np.random.default_rng(4)
    hashes, place = rng.integers(0, 2 ** 64, 5000, dtype=np.uint64), np.sort(rng.integers(0, 6, 5000))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(int)
    want = [(2 * bits[place == k] - 1).sum(axis=0).tolist() for k in range(6)]
    assert fuzzy_lines.votes(hashes, place, 6).tolist() == want


def test_unrelated_long_lines_share_few_keys():
    """Blocks of frequent words alone made their candidates grow with the square of the lines."""
    rng = random.Random(3)
    frequent = [f"f{k}" for k in range(12)]
    text = "\n".join(" ".join(rng.choice(frequent) if rng.random() < 0.5 else f"w{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(80, 120)))
                     for _ in range(1500))
    found = words.split_words(pa.array([text]), words.ALPHANUMERIC, lower=True)
    keys, _ = fuzzy_lines.block_keys(found, *fuzzy_lines.line_spans(found)[2:])
    times = np.unique(keys, return_counts=True)[1]
    assert (times * (times - 1) // 2).sum() <= 150, (times * (times - 1) // 2).sum()


def test_lines_odd_rows(odd_rows, nothing):
    assert fuzzy_lines.without_repeated_lines(nothing).count() == 0
    done = fuzzy_lines.without_repeated_lines(odd_rows)
    assert set(done.columns) == {*odd_rows.columns, "lines_removed"}
    rows = done.collect()
    assert len(rows) == 6
    assert [r["text"] for r in rows if r["doc_id"] is None and r["text"] is not None] == [""]  # id 1 has them first
    assert all(r["lines_removed"] == 0 for r in rows if r["doc_id"] == 1)


def test_lines_one_word_apart_meet(spark):
    rng = random.Random(8)
    rows, pairs = [], [n for n in (5, 7, 9, 10, 14, 19, 20, 25, 40, 90) for _ in range(4)]
    for k, n in enumerate(pairs):
        line = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
        near = list(line)
        at = rng.randrange(n)
        near[at] = near[at][:3] + "zz" + near[at][5:]
        rows += [(2 * k, " ".join(line)), (2 * k + 1, " ".join(near))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    gone = {r["id"] for r in fuzzy_lines.repeated_line_numbers(docs).collect()}
    assert gone == {2 * k + 1 for k in range(len(pairs))}


def test_equal_lines_of_any_length_go(spark):
    docs = spark.createDataFrame([(1, "Thanks!\n\n--\nNot thanks"), (2, "thanks\n--\nsee you"), (3, "See you.\nthank")],
                                 "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in fuzzy_lines.without_repeated_lines(docs).collect()}
    assert got == {1: "Thanks!\n\n--\nNot thanks", 2: "--\nsee you", 3: "thank"}


def test_lines_that_are_near_by_edit_similarity_alone_are_found(spark):
    """A run over a whole table against all pairs of its lines: at most one occurrence of two near lines stays."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    places = [(r["doc_id"], k, " ".join(reference.alnum(x))) for r in docs.collect() for k, x in enumerate((r["text"] or "").split("\n"))]
    gone = {(r["id"], r["line"]) for r in fuzzy_lines.repeated_line_numbers(docs).collect()}
    stay = Counter(form for i, k, form in places if (i, k) not in gone)
    forms = spark.createDataFrame([(f, len(f)) for f in {p[2] for p in places} if len(f.split(" ")) >= 4], "form string, n int")
    other = forms.select(F.col("form").alias("near"), F.col("n").alias("m"))
    near = forms.join(other, (F.col("form") < F.col("near")) & (F.least("n", "m") * 10 >= F.greatest("n", "m") * 9) & F.expr(
        "levenshtein(form, near, cast(floor(greatest(n, m) / 10) as int)) >= 0")).collect()
    found = sum(stay[r["form"]] + stay[r["near"]] <= 1 for r in near)
    assert len(near) > 30 and found >= 0.9 * len(near), (found, len(near))
