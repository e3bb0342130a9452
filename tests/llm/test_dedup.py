"""SimHash, substring removal and decontamination against brute force."""

import hashlib
import random
import re
import time

import numpy as np
import xxhash
from conftest import prose
from pyspark.sql import functions as F

from memspark.llm import common, decontaminate, nearcopies, simhash, substring
from memspark.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, near):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(values))]


def test_simhash_equals_brute_force(spark, odd, odd_rows):
    found = sorted((str(r.doc_id), r.fp & (2**64 - 1), str(r.component_id)) for r in simhash.near_duplicates(odd).collect())
    fps = [fingerprint(t) for _, t in odd_rows]
    of = groups(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {g: min((i for (i, _), h in zip(odd_rows, of) if h == g and i is not None), default=None) for g in of}
    assert found == sorted((str(i), f, str(least[g])) for (i, _), f, g in zip(odd_rows, fps, of))


def test_simhash_empty_and_kept_columns(spark, odd, empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.dedup(empty).columns == empty.columns
    kept = simhash.dedup(odd)
    assert kept.columns == odd.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    ids = [i for i, _ in rows]
    assert len(rows) == len(set(rows)) and {0, 1, 2, 3} <= set(ids) and not {100, 101, 102, 103} & set(ids)


def five_words(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_dedup_joins_texts_at_jaccard_of_four_fifths(spark):
    """Copies with a few changed words: far apart as fingerprints, near as sets of five-word shingles."""
    rnd = random.Random(8)
    rows = []
    for n in range(12):
        words = [rnd.choice("abcdefghijklmnop") + str(rnd.randrange(60)) for _ in range(120)]
        for c in range(7):
            other = list(words)
            for p in rnd.sample(range(120), c):
                other[p] = f"new{rnd.randrange(10**6)}"
            rows.append((100 * c + n, " ".join(other)))
    rows += [(900, "One  two"), (901, "one two"), (902, None), (903, " "), (904, "one three")]
    sets = [five_words(t) for _, t in rows]
    of = groups(sets, lambda a, b: jaccard(a, b) >= 0.8)
    want = {min(i for (i, _), h in zip(rows, of) if h == g) for g in of}
    assert len(want) < len(rows) - 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.dedup(docs).collect()} == want


def test_dedup_tells_texts_of_one_id_apart(spark):
    a, b = prose(random.Random(1), 60), prose(random.Random(2), 60)
    rows = [(2, a), (5, a), (5, b), (5, b), (None, a), (None, "only here"), (None, "only here"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), str(r.text)) for r in simhash.dedup(docs).collect())
    assert got == sorted([("2", a), ("5", b), ("None", "only here"), ("7", "None")])


def test_dedup_checks_every_pair_of_a_bucket(spark, monkeypatch):
    """A and B are near, the smallest member of their buckets is near to neither; also cut into blocks."""
    rnd = random.Random(12)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    rows = []
    for n in range(40):
        words = list(base)
        for p in rnd.sample(range(200), rnd.choice([1, 4, 9, 14])):
            words[p] = f"x{rnd.randrange(10**6)}"
        rows.append((n, " ".join(words)))
    sets = [five_words(t) for _, t in rows]
    of = groups(sets, lambda a, b: jaccard(a, b) >= 0.8)
    want = sorted(min(i for (i, _), h in zip(rows, of) if h == g) for g in set(of))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size in (512, 4):
        monkeypatch.setattr(nearcopies, "BLOCK", size)
        assert sorted(r.doc_id for r in simhash.dedup(docs).collect()) == want


def test_covering_masks_miss_no_pair_within_the_radius():
    masks = simhash.covering_masks()
    rnd = random.Random(1)
    for _ in range(20000):
        diff = 0
        for b in rnd.sample(range(64), rnd.randrange(1, 5)):
            diff |= 1 << b
        assert any(not diff & m for m in masks)


def test_large_bucket_is_cut_without_losing_links(monkeypatch):
    rnd = np.random.default_rng(2)
    centre = rnd.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([centre ^ (np.uint64(1) << rnd.integers(0, 64, 40).astype(np.uint64)) for _ in range(5)] + [centre]))
    whole = simhash.walk(values, 4)
    monkeypatch.setattr(simhash, "WALK", 16)
    parts = simhash.bucket_links(values, 4)

    def classes(pairs):
        parent = {int(v): int(v) for v in values}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[root(a)] = root(b)
        return len({root(int(v)) for v in values})

    assert classes(whole) == classes(parts)
    assert all((a ^ b).bit_count() <= 4 for a, b in parts)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (-5, 200), (200, -9)]
    found = {r.node: r.label for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[100 + i] == 100 for i in range(30))
    assert found[200] == found[-5] == found[-9] == -9
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def removal(rows):
    first = {}
    texts = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for p in range(len(t) - 49):
            w = t[p:p + 50]
            first[w] = min(i, first.get(w, i))
    out = []
    for (i, _), (key, t) in zip(rows, texts):
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p:p + 50]] < key:
                gone[p:p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(t)))
        out.append((str(i), len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_substrings_equal_brute_force(spark, odd, odd_rows, empty, monkeypatch):
    for chunk in (1 << 22, 2000):  # one chunk for each partition, and many
        monkeypatch.setattr(substring, "CHUNK", chunk)
        found = sorted((str(r[0]), *r[1:]) for r in substring.dedup_spans(odd).collect())
        assert found == removal(odd_rows)
    assert substring.dedup_spans(empty).count() == 0


def test_substrings_on_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(120)
    rows = [tuple(r) for r in docs.collect()]
    split = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((str(r[0]), *r[1:]) for r in substring.dedup_spans(split).collect()) == removal(rows)


def test_levels_are_suffix_arrays_in_true_order(monkeypatch):
    rnd = random.Random(3)
    family = substring.Family()
    total: dict[bytes, int] = {}
    scans = []
    monkeypatch.setattr(substring, "scan", lambda a, b, f=substring.scan: scans.append(a) or f(a, b))
    for i in range(40):
        texts = [bytes(rnd.choice(b"\x00ab") for _ in range(70)) for _ in range(5)]
        texts += list(total)[:3] if i % 7 == 0 else []  # windows met before
        for t in texts:
            for p in range(len(t) - 49):
                total[t[p:p + 50]] = min(total.get(t[p:p + 50], 100), 100 - i)
        batch, place = substring.suffix_array(texts, np.full(len(texts), 100 - i))
        before = list(family.levels)
        scans.clear()
        family.add(batch)
        assert scans == before  # each level was scanned once, before the batch joined
        whole = b"".join(texts)
        starts = [sum(map(len, texts[:n])) + p for n, t in enumerate(texts) for p in range(len(t) - 49)]
        assert [whole[s:s + 50] for s in starts] == [w.ljust(50, b"\x00") for w in batch.windows()[place].tolist()]
    assert len(family.levels) <= 8 and all(len(a) > 2 * len(b) for a, b in zip(family.levels, family.levels[1:]))
    found: dict[bytes, int] = {}
    for level in family.levels:
        words = [w.ljust(50, b"\x00") for w in level.windows().tolist()]
        assert words == sorted(set(words))
        for w, x in zip(words, level.ids.tolist()):
            found[w] = min(x, found.get(w, x))
    assert found == total


def test_substrings_in_small_batches(spark, odd, odd_rows, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK", 500)
    monkeypatch.setattr(substring, "BATCH", 200)
    whole = sorted(odd_rows, key=lambda r: str(r[0]), reverse=True)  # ids do not rise with the chunks
    split = spark.createDataFrame(whole, "doc_id long, text string").coalesce(1)
    found = sorted((str(r[0]), *r[1:]) for r in substring.dedup_spans(split).collect())
    assert found == removal(odd_rows)


def test_suffix_index_takes_batches(spark, odd, odd_rows, tmp_path):
    """Batches given one by one and all at once give what brute force gives."""
    known = sorted((r for r in odd_rows if r[0] is not None), key=lambda r: r[0])
    ids = sorted({r[0] for r in known})
    expected = removal(known)
    for cuts in ([0, len(ids)], [0, 3, 8, 9, len(ids)]):
        index = substring.SuffixIndex(spark, f"{tmp_path}/index-{len(cuts)}", buckets=3)
        found = []
        for a, b in zip(cuts, cuts[1:]):
            part = [r for r in known if r[0] in ids[a:b]]
            found += [tuple(r) for r in index.append(spark.createDataFrame(part, "doc_id long, text string")).collect()]
            index = substring.SuffixIndex(spark, index.folder)  # what counts is in the folder
        assert sorted((str(r[0]), *r[1:]) for r in found) == expected
        sizes = [n for _, n in index.levels]
        assert sizes and all(x > 2 * y for x, y in zip(sizes, sizes[1:]))
        names = {p.name for p in (tmp_path / f"index-{len(cuts)}").iterdir() if p.name.startswith("level-")}
        assert names == {n for n, _ in index.levels}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert index.append(empty).count() == 0
    again = index.append(spark.createDataFrame([(10_000, "new words only"), (10_001, known[0][1])], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in again} == {10_000: 0, 10_001: len(known[0][1].encode())}


def edited(rnd, text, rate):
    out = list(text)
    for _ in range(int(len(text) * rate)):
        p = rnd.randrange(len(out))
        out[p:p + 1] = rnd.choice([[], ["q"], [out[p], "z"]])
    return "".join(out)


def indexed(items):
    return decontaminate.Index([(i, decontaminate.trimmed(t)) for i, t in items])


def test_decontamination(spark, odd, empty):
    rnd = random.Random(4)
    items = [(n, prose(rnd, 40)) for n in range(6)] + [(90, None), (91, "short"), (92, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for n in range(6):
        inside = items[n][1]
        rows.append((1000 + n, prose(rnd, 60) + " " + inside.upper().replace(" ", "  ") + "! " + prose(rnd, 60)))
        rows.append((2000 + n, prose(rnd, 60) + " " + edited(rnd, inside, 0.02) + " " + prose(rnd, 60)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    found = decontaminate.matches(docs, bench)
    pairs = {(r.doc_id, r.item_id) for r in found.collect()}
    assert pairs == {(1000 + n, n) for n in range(6)} | {(2000 + n, n) for n in range(6)}
    left = decontaminate.remove(docs, bench)
    assert left.count() == docs.count() - 12 and left.columns == docs.columns
    assert decontaminate.matches(empty, bench).count() == 0
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0
    # rows without an id match and go one by one; names that we use ourselves are no matter
    odd_ids = spark.createDataFrame(
        [(None, items[0][1], 1), (None, "clean " * 30, 2), (7, items[1][1], 3), (7, prose(rnd, 40), 4), (8, None, 5)],
        "doc_id long, text string, _bad_id int")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(odd_ids, bench).collect()} == {(None, 0), (7, 1)}
    assert sorted(r._bad_id for r in decontaminate.remove(odd_ids, bench).collect()) == [2, 4, 5]


def test_windows_of_long_items_keep_their_places():
    rnd = random.Random(12)
    norm = decontaminate.trimmed(prose(rnd, 2000))
    whole = {norm[s:e].tobytes() for s, e in decontaminate._spans(norm)}
    parts = list(decontaminate.cut(5, norm, 2000))
    assert len(parts) > 3 and all(len(p) <= 2000 for _, p in parts)
    assert whole <= {p[s:e].tobytes() for _, p in parts for s, e in decontaminate._spans(p)}


def test_short_items_match_without_an_edit():
    index = indexed([(1, "seventeen tiny words"), (2, "too short")])
    found = decontaminate.find_in(index, ["so Seventeen, tiny words!", "seventeen tony words", "too short"])
    assert [(d, item, s, e) for d, item, s, e, *_ in found] == [(0, 1, 3, 24)]


def test_a_sentence_that_all_items_share_is_no_burden():
    """Equal windows are one; repeats of it in a document are one stretch."""
    rnd = random.Random(14)
    shared = "all of these items begin with this very sentence that says nothing at all about what they ask "
    items = [(n, shared + prose(rnd, 30)) for n in range(800)]
    start = time.perf_counter()
    index = indexed(items)
    built = time.perf_counter()
    found = decontaminate.find_in(index, [shared * 100])
    took = time.perf_counter() - built
    assert len(found) <= 800 and {d for d, *_ in found} == {0}
    assert min(s for _, _, s, *_ in found) == 0 and max(e for _, _, _, e, *_ in found) == len((shared * 100).strip())
    assert took < 5 and built - start < 20, (took, built - start)


def test_work_does_not_grow_with_the_items_that_share_a_sentence(monkeypatch):
    """The hits that are laid on bands and the windows aligned do not grow with the items that share a sentence."""
    work = []
    for name in ("_count", "_align"):
        def counted(self, *args, call=getattr(decontaminate.Index, name)):
            work[-1] += int(args[2].sum()) if call.__name__ == "_count" else len(args[2])
            return call(self, *args)

        monkeypatch.setattr(decontaminate.Index, name, counted)
    shared = "all of these items begin with this very sentence that says nothing at all about what they ask "
    for n in (200, 1600):
        rnd = random.Random(14)
        items = [(i, shared + prose(rnd, 30)) for i in range(n)]
        index = indexed(items)
        for text in (shared * 100, " ".join(shared + prose(rnd, 12) for _ in range(40)), shared + items[3][1] + " " + edited(rnd, items[4][1], 0.02)):
            work.append(0)
            found = decontaminate.find_in(index, [text])
            assert len(found) < 500 and {d for d, *_ in found} == {0}
            if text == shared * 100:
                assert min(s for _, _, s, *_ in found) == 0 and max(e for _, _, _, e, *_ in found) == len(text.strip())
        assert {3, 4} <= {item for _, item, *_ in found}
    few, many = work[:3], work[3:]
    assert few[0] == many[0] == 0 and many[2] < 3 * few[2] + 3000 and many[1] < 8 * few[1] + 3000


def plain_decontamination(docs, items):
    """(document, item) pairs by definition: a window of the item within its edits of some stretch of the document.

    Windows that equal one of an item of a smaller id are that item's.
    """
    owner, out = {}, set()
    for i, text in sorted(items):
        norm = decontaminate.trimmed(text)
        for s, e in decontaminate._spans(norm) if len(norm) >= decontaminate.Q else []:
            owner.setdefault(norm[s:e].tobytes(), i)
    for d, text in docs:
        norm, _ = decontaminate.normalise(decontaminate.codes_of(text or ""))
        for window, i in owner.items():
            if (d, i) not in out:
                w = np.frombuffer(window, np.uint32)
                if edit_distance_inside(w.tolist(), norm.tolist()) <= decontaminate.bound(len(w))[0]:
                    out.add((d, i))
    return out


def test_decontamination_query_equals_brute_force(spark, tmp_path):
    """The registered query on a small folder of tables, against every window's edit distance to every document."""
    rnd = random.Random(31)
    items = [(n, prose(rnd, 17)) for n in range(4)] + [(7, prose(rnd, 15))]
    docs = [(n, prose(rnd, 25)) for n in range(4)] + [(10 + n, prose(rnd, 8) + " " + edited(rnd, t, 0.02) + " " + prose(rnd, 8)) for n, t in items]
    docs += [(30, items[0][1].upper()), (31, None), (32, ""), (33, items[1][1][:40] + " " + prose(rnd, 20))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = QUERIES["op2_qgram_decontamination"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == plain_decontamination(docs, items)


def test_decontamination_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "INDEX_CHARS", 700)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    whole = {(d, i) for d, t in docs.select("doc_id", "text").collect() for i, b in bench.collect() if b in t}
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()}
    assert whole and whole <= found


def test_short_excerpts_are_found_at_every_offset():
    """13 to 20 words, and 84 code points without a blank, from any place of an item; foreign text is not."""
    rnd = random.Random(21)
    words = prose(rnd, 70).replace(".", "").split()
    solid = "".join(rnd.choice("abcdefghij") for _ in range(300))
    index = indexed([(1, " ".join(words)), (2, solid)])
    texts = [(1, " ".join(words[i:i + n])) for n in (13, 15, 17, 20) for i in range(len(words) - n + 1)]
    texts += [(2, solid[i:i + 84]) for i in range(len(solid) - 83)]
    group = [f"{prose(rnd, 20)} {t} {prose(rnd, 20)}" for _, t in texts]
    found = {(d, item) for d, item, *_ in decontaminate.find_in(index, group)}
    assert found >= {(n, item) for n, (item, _) in enumerate(texts)}
    clean = [prose(rnd, 60) for _ in range(100)]
    assert not decontaminate.find_in(index, clean)


def edit_distance_inside(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != c), row[i] + 1, new[-1] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_every_window_within_the_budget_is_found():
    rnd = random.Random(9)
    item = prose(rnd, 60)
    index = indexed([(1, item)])
    for _ in range(40):
        text = prose(rnd, 30) + " " + edited(rnd, item[40:170], rnd.choice([0.01, 0.03, 0.06])) + " " + prose(rnd, 30)
        norm, _ = decontaminate.normalise(decontaminate.codes_of(text))
        found = {w for w, *_ in index.find(norm, np.zeros(len(norm), int), every=True)}
        for n in range(len(index.at)):
            assert (n in found) == (edit_distance_inside(index.window(n).tolist(), norm.tolist()) <= index.k[n])
        some = {w for w, *_ in index.find(norm, np.zeros(len(norm), int))}
        assert some <= found and bool(some) == bool(found)


def test_dedup_gets_candidates_from_simhash(spark, monkeypatch):
    """With MinHash keys that never meet, near copies are still found by their fingerprints, and only those that are similar."""
    words = [f"w{i}" for i in range(400)]
    other = [f"x{i}" for i in range(400)]
    texts = {1: " ".join(words), 2: " ".join(words) + " end", 3: " ".join(other), 4: " ".join(other) + " end"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert len({r.component_id for r in simhash.near_duplicates(docs).collect()}) == 2
    whole = nearcopies.signatures
    monkeypatch.setattr(nearcopies, "signatures", lambda *a: whole(*a).withColumn("keys", F.array("fp")))
    assert sorted(r.doc_id for r in simhash.dedup(docs).collect()) == [1, 3]
