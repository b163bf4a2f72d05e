import random
import re

import numpy as np
import pyarrow as pa

from foliospark.llm import _spark, passages
from foliospark.llm.passages import compact_windows, cut_passages, drop_passages, linked_windows, near_passages

SCHEMA = "doc_id long, text string"


def split(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_windows_hold_each_subsequence_once():
    rng = np.random.default_rng(2)
    for t in (1, 3, 7):
        values, row = rng.integers(0, 9, 60).astype(np.uint64), np.repeat([0, 1, 2], [25, 5, 30])
        windows = list(zip(*(x.tolist() for x in compact_windows(values, row, t)), strict=True))
        for i in range(60):
            for j in range(i + t - 1, 60):
                if row[i] != row[j]:
                    continue
                # equal least tokens share a window: those of its value in it
                holding = [c for left, c, right in windows if left <= i <= j <= right and values[c] in values[i : j + 1]]
                holding = [c for c in holding if values[c] == values[i : j + 1].min()]
                assert len(holding) == 1


def corpus(edits):
    rng = random.Random(edits)
    words = [f"w{i}" for i in range(2000)]
    shared = [[rng.choice(words) for _ in range(rng.randrange(55, 90))] for _ in range(12)]
    rows, planted = [], {}
    for d in range(120):
        text = [rng.choice(words) for _ in range(rng.randrange(10, 150))]
        if d % 2:
            copy = list(shared[rng.randrange(12)])
            which = shared.index(copy)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            at = rng.randrange(len(text))
            text[at:at] = copy
            planted.setdefault(which, []).append((d, at, at + len(copy)))
        rows.append((d, " ".join(text)))
    return rows, planted


def test_recall(spark):
    for edits, least in ((0, 1.0), (1, 0.9)):
        rows, planted = corpus(edits)
        got = near_passages(spark.createDataFrame(rows, SCHEMA)).collect()
        covered, of = {}, {}
        for r in got:
            covered.setdefault(r.doc_id, set()).update(range(r.start, r.stop))
            of.setdefault((r.class_doc, r.class_start), set()).add(r.doc_id)
            assert (r.class_doc, r.class_start) <= (r.doc_id, r.start)
        want = [x for group in planted.values() if len(group) > 1 for x in group]
        assert sum(len(covered.get(d, set()) & set(range(s, e))) >= 0.7 * (e - s) for d, s, e in want) >= least * len(want)
        assert all(d % 2 for d in covered)  # clean documents have none
        groups = [{d for d, _, _ in group} for group in planted.values()]
        assert all(len(docs) > 1 and any(docs <= group for group in groups) for docs in of.values())  # a class is of one passage
        sizes = {d: len(group) for group in groups for d in group}
        assert all(0 < r.links < sizes[r.doc_id] for r in got)
        if not edits:
            assert all(r.links == sizes[r.doc_id] - 1 for r in got)


def test_documents_against_brute_force(spark, sf):
    """Exactly shared runs of 52 words: all but a tenth of the later ones are found."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    seen, want = {}, set()
    rows = sorted(tuple(r) for r in docs.collect())
    for d, t in rows:
        words = split(t)
        for i in range(len(words) - 51):
            key = tuple(words[i : i + 52])
            if seen.setdefault(key, d) != d:
                want.add((d, i + 26))
    got = set()
    for r in linked_windows(docs).where("le >= ls").collect():
        got.update((r.doc_id, i) for i in range(r.ls, r.le + 5))
    assert len(want & got) >= 0.9 * len(want) > 0


def test_cut_and_edges(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, "Start. " + passage + ", end!"), (4, "Other; " + passage.upper() + " tail."), (5, passage), (None, passage), (3, "Start. " + passage + ", end!"), (6, "é " * 50_000)]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "k") for r in rows], SCHEMA + ", n_chars long, key string")
    assert {tuple(r) for r in near_passages(docs).collect()} == {(3, 1, 61, 3, 1, 2), (4, 1, 61, 3, 1, 2), (5, 0, 60, 3, 1, 2)}
    kept = drop_passages(docs)
    assert kept.columns == docs.columns
    texts = {(r.doc_id, r.text, r.n_chars) for r in kept.collect() if r.doc_id != 6}
    assert texts == {(1, None, 0), (2, "", 0), (3, rows[2][1], len(rows[2][1])), (4, "Other; tail.", 12), (None, passage, len(passage))}
    assert near_passages(docs.limit(0)).count() == 0 and drop_passages(docs.limit(0)).count() == 0
    spans = spark.createDataFrame([(3, 0, 1), (3, 60, 62)], "doc_id long, start int, stop int")
    assert {r.text for r in cut_passages(docs.where("doc_id = 3"), spans).collect()} == {passage[: passage.index("word59")]}


def test_links_in_groups(spark, monkeypatch):
    """Every member of a group is a query: links are counted with all others, whether a group is one unit or many blocks."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows, want = [], {}
    for group, (edits, n) in enumerate(((1, 5), (1, 5), (1, 5), (1, 5), (1, 20), (1, 50), (0, 20))):
        passage, members = [rng.choice(words) for _ in range(75)], []
        for _ in range(n):
            copy = list(passage)
            for _ in range(edits):
                copy[rng.randrange(75)] = rng.choice(words)
            members.append((len(rows), {tuple(copy[i : i + 5]) for i in range(71)}))
            rows.append((len(rows), " ".join([*rng.choices(words, k=rng.randrange(60)), *copy, *rng.choices(words, k=rng.randrange(60))])))
        for d, x in members:
            want[d] = (members[0][0], sum(len(x & y) >= 0.7 * len(x | y) for e, y in members if e != d), (edits, n))
    docs = spark.createDataFrame(rows, SCHEMA)
    for block in (passages.BLOCK, 6):
        monkeypatch.setattr(passages, "BLOCK", block)
        got = {}
        for r in near_passages(docs).collect():
            got[r.doc_id] = (r.class_doc, max(r.links, got.get(r.doc_id, (0, 0))[1]))
        for kind in {k for _, _, k in want.values()}:
            docs_ = [d for d in want if want[d][2] == kind]
            links, most = sum(got.get(d, (0, 0))[1] for d in docs_), sum(want[d][1] for d in docs_)
            assert 0.9 * most <= links <= 1.02 * most, (block, kind, links, most)
            assert sum(got.get(d, (-1, 0))[0] == want[d][0] for d in docs_) >= 0.9 * len(docs_)


def test_salted_values(spark, monkeypatch):
    """A passage that is in most documents is found in all of them, though its windows are spread."""
    monkeypatch.setattr(_spark, "HOT", 2)
    monkeypatch.setattr(_spark, "SAMPLE", 2)
    monkeypatch.setattr(_spark, "SALTED", 16)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.choices(words, k=60)
    rows = [(d, " ".join([*rng.choices(words, k=50), *(passage if d % 3 else []), *rng.choices(words, k=50)])) for d in range(90)]
    got = {r.doc_id: r for r in near_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {d for d in range(90) if d % 3}
    assert all((r.class_doc, r.links) == (1, 59) and r.start <= 50 and r.stop >= 110 for r in got.values())
    kept = {r.doc_id: len(r.text.split()) for r in drop_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(kept[d] == (160 if d == 1 else 100) for d in kept if d % 3)


def test_repeated_ids_with_other_texts(spark):
    """The row with the least text is the document."""
    rng = random.Random(7)
    passage = " ".join(rng.choices([f"w{i}" for i in range(3000)], k=120))
    docs = spark.createDataFrame([(1, "a b", 0), (1, passage, 0), (2, passage, 0), (3, "zz " + passage, 0)], SCHEMA + ", __spans int")
    assert {tuple(r) for r in near_passages(docs).collect()} == {(2, 0, 120, 2, 0, 1), (3, 1, 121, 2, 0, 1)}
    spans = docs.selectExpr("doc_id", "0 as start", "1 as stop").where("doc_id = 3")
    assert cut_passages(docs, spans).columns == docs.columns


def test_partial_copies_at_a_lower_doc_id(spark):
    """Equal passages are found also when an earlier document has too little of them to be a passage."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    rows, want = [], set()
    for n in range(60):
        passage, part = [rng.choice(words) for _ in range(55)], (30, 40, 45)[n % 3]
        at = rng.randrange(55 - part)
        for copy in (passage[at : at + part], passage, passage):
            rows.append((len(rows), " ".join([*rng.choices(words, k=60), *copy, *rng.choices(words, k=60)])))
        want.add((len(rows) - 2, len(rows) - 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {(r.class_doc, r.doc_id) for r in near_passages(docs).collect() if r.doc_id != r.class_doc} == want
    kept = {r.doc_id: len(r.text.split()) for r in drop_passages(docs).collect()}
    assert all(kept[a] == 175 and kept[b] <= 120 for a, b in want)


def test_edits_that_lie_together(spark):
    """Deletions, insertions and clustered edits leave near copies above the threshold, which are one passage each."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    make = {
        "deleted": lambda p: p[:44] + p[47:],
        "inserted": lambda p: p[:45] + rng.choices(words, k=3) + p[45:],
        "replaced": lambda p: p[:43] + ["x1"] + p[44:46] + ["x2"] + p[47:],
    }
    for edit, change in make.items():
        rows = []
        for _ in range(20):
            passage = [rng.choice(words) for _ in range(90)]
            for copy in (passage, change(passage)):
                rows.append((len(rows), " ".join([*rng.choices(words, k=30), *copy, *rng.choices(words, k=30)])))
        got = near_passages(spark.createDataFrame(rows, SCHEMA)).collect()
        whole = {(r.class_doc, r.doc_id) for r in got if r.doc_id != r.class_doc and r.stop - r.start >= 85}
        assert len(whole) >= 18, edit


def test_passages_with_an_edit_near_an_end(spark):
    """51 words with one of the outer words replaced leave a run of 44 or 45 tokens, which is a passage."""
    rng = random.Random(10)
    words = [f"w{i}" for i in range(3000)]
    rows, want = [], set()
    for n in range(40):
        passage = [rng.choice(words) for _ in range(51)]
        copy = list(passage)
        copy[(1, 2, 48, 49)[n % 4]] = "x"
        for one in (passage, copy):
            rows.append((len(rows), " ".join([*rng.choices(words, k=30), *one, *rng.choices(words, k=30)])))
        want.add((len(rows) - 2, len(rows) - 1))
    found = {(r.class_doc, r.doc_id) for r in near_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(found & want) >= 0.9 * len(want)


def test_pairs_of_edited_copies_at_once(monkeypatch):
    """Of n edited copies in one unit nearly all pairs are verified together, with what each pair gives by itself; also where words are moved, repeated, inserted or left out."""
    rng = np.random.default_rng(11)
    base, rows = rng.integers(0, 1 << 16, 120), []
    for d in range(400):
        words, c = base.copy(), 57
        edits = rng.choice(np.r_[:50, 66:120], rng.integers(9), replace=False)
        words[edits] = rng.integers(0, 1 << 16, len(edits))
        if d % 20 == 1:
            words = np.r_[words[10:30], words[:10], words[30:]]
        elif d % 20 == 2:
            words = np.r_[words[:90], words[70:90], words[90:]]
        elif d % 20 == 3:
            words, c = np.delete(words, rng.integers(50)), 56
        elif d % 20 == 4:
            words = np.insert(words, 90, rng.integers(1 << 16, size=3))
        elif d % 20 == 5:
            words = words[: rng.integers(90, 120)]
        rows.append((d, d, 1, c, words.astype(np.uint16).tobytes()))
    kinds = {"doc": pa.int64(), "last": pa.int64(), "copies": pa.int64(), "c": pa.int32(), "words": pa.binary()}
    batch = pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))
    alone, number = passages._Places.parts, [0]

    def counted(self, a, *rest):
        number[0] += len(a)
        return alone(self, a, *rest)

    monkeypatch.setattr(passages._Places, "parts", counted)
    got = passages._links(batch, np.array([0]), None, 5, 44, 0.7)
    together, number[0] = number[0], 0
    monkeypatch.setattr(passages, "LEAST_CELLS", 1 << 40, raising=False)
    want = passages._links(batch, np.array([0]), None, 5, 44, 0.7)
    assert all((got[k] == want[k]).all() for k in want) and want["links"].sum() > 50_000
    assert number[0] > 20_000 and together < number[0] / 4, (together, number[0])
