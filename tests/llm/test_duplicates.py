"""Passages, n-gram Jaccard join, lines and decontamination against brute force."""

import random
from collections import Counter

from tallyreef.llm import decontaminate, jaccard, lines, passages

from .helpers import ODD, docs, prose


def grams(text, n=5):
    w = (text or "").lower().split()
    n = min(n, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def corpus(seed=3, groups=12):
    """Bases with copies and edited copies, one large group among them."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = prose(1000 + g, 90).split()
        for _ in range(25 if g == 0 else rng.randrange(1, 5)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((100 + len(rows), " ".join(w)))
    return rows


def test_classes_are_those_of_brute_force(spark):
    rows = [r[:2] for r in ODD if r[0] is not None and r[0] != 7] + [(7, prose(7))] + corpus()
    sets = [grams(t) for _, t in rows]
    root, links = list(range(len(rows))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            u = len(sets[i] | sets[j])
            if u and len(sets[i] & sets[j]) / u >= 0.8:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    want = {doc: (least[find(i)], links[i]) for i, (doc, _) in enumerate(rows)}
    for blocks in (1500, 4):  # whole buckets, and buckets split into pairs of blocks
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.classes(docs(spark, rows, extra=True), block_rows=blocks).collect()}
        assert got == want
    assert max(n for _, n in want.values()) > 10


def test_join_of_odd_and_empty_tables(spark):
    got = jaccard.classes(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert {r["doc_id"]: r["n_links"] for r in got}[1] == 0
    assert {r["class_id"] for r in got if r["doc_id"] in (7, 8)} == {7}
    assert jaccard.classes(docs(spark, [])).count() == 0
    kept = jaccard.keep_one(docs(spark, ODD, extra=True))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 10]
    assert kept.columns == docs(spark, ODD, extra=True).columns


def test_banding_meets_its_recall():
    for threshold in (0.5, 0.8, 0.95, 1.0):
        bands, rows = jaccard.banding(threshold, 0.999)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999


def words_of(text):
    import re

    return [x for x in re.split(r"[\W_]+", text.lower()) if x]


def test_leaks_are_those_of_brute_force(spark):
    rng = random.Random(5)
    items = [(k, prose(5000 + k, rng.randrange(14, 60))) for k in range(12)] + [(90, "only three words"), (91, ""), (92, None), (93, prose(5000, 40).upper())]
    rows = list(ODD)
    for k in range(60):
        w = prose(7000 + k, 80).split()
        item = items[k % 12][1].split()
        cut = rng.choice([0, 0, 1, 2, len(item) // 2])
        w[20:20] = item[cut:]
        rows.append((200 + k, " ".join(w)))
    rows += [(300, "these are only three words here"), (301, items[0][1]), (302, items[1][1] + " " + items[2][1])]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(docs(spark, rows, extra=True), b).collect()}
    want = {}
    for doc, text in {r[:2] for r in rows}:
        w = words_of(text or "")
        for item, said in items:
            v = words_of(said or "")
            m = min(5, len(v))
            if not m:
                continue
            g = Counter(tuple(v[i : i + m]) for i in range(len(v) - m + 1))
            own = set(zip(*[w[k:] for k in range(m)], strict=False))
            if not own & set(g):
                continue
            best = 0
            for s in range(-len(v) + 1, len(w)):
                x = w[max(s, 0) : s + len(v)]
                h = Counter(tuple(x[i : i + m]) for i in range(len(x) - m + 1))
                c = sum((g & h).values())
                best = max(best, c / (sum(g.values()) + sum(h.values()) - c))
            if best >= 0.8:
                want[doc, item] = best
    assert len(want) > 30
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    parted = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(docs(spark, rows), b, at_once=150).collect()}
    assert parted == got
    kept = {r["doc_id"] for r in decontaminate.without_leaks(docs(spark, rows), b).collect()}
    assert kept == {r[0] for r in rows} - {k[0] for k in want}


def test_leaks_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs(spark, ODD), none).count() == 0
    assert decontaminate.leaks(docs(spark, []), spark.createDataFrame([(1, prose(1))], none.schema)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_lines_are_those_of_brute_force(spark):
    rng, rows = random.Random(9), []
    bases = [" ".join(prose(40 + k, 6).split()) for k in range(8)]
    for doc in range(40):
        own = []
        for _ in range(4):
            s = list(rng.choice(bases))
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(s))
                kind = rng.randrange(3)
                s[at : at + (kind > 0)] = ["z"] if kind < 2 else []
            own.append(rng.choice(["", "  "]) + "".join(s))
        rows.append((doc, "\n".join([*own, "short", "", "short"])))
    got = lines.classes(docs(spark, rows, extra=True), edits=2).collect()
    texts = {}
    for doc, text in rows:
        for k, x in enumerate(text.split("\n")):
            if x.strip():
                texts.setdefault((doc, x.strip()), k)
    assert len(got) == len(texts)
    of = {(r["doc_id"], r["line_no"]): r for r in got}
    kinds = sorted({x for _, x in texts})
    root = {x: x for x in kinds}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(kinds):
        for y in kinds[:i]:
            if len(x) >= 24 and len(y) >= 24 and abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2:
                root[find(x)] = find(y)
    pairs = {(find(x), of[doc, k]["class_id"]) for (doc, x), k in texts.items()}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) < len(kinds)
    keep = Counter(r["class_id"] for r in got if r["keep"])
    assert set(keep.values()) == {1} and len(keep) == len({b for _, b in pairs})


def test_lines_of_odd_and_empty_tables(spark):
    got = lines.classes(docs(spark, ODD)).collect()
    assert {r["doc_id"] for r in got} == {4, 5, 6, 7, 8, 10, None}
    assert lines.classes(docs(spark, [])).count() == 0


def test_passages_across_documents(spark):
    shared, near = prose(1, 70), prose(2, 70).split()
    edited = list(near)
    edited[30] = "changed"
    rows = [(100 + k, f"{prose(100 + k, 40)} {shared} {prose(200 + k, 40)}") for k in range(30)]
    rows += [(250, f"{prose(300)} {' '.join(near)} {prose(301, 10)}"), (251, f"{prose(302, 15)} {' '.join(edited)} {prose(303)}"), (260, prose(400)), (261, f"{prose(401, 60)} {prose(401, 60)}")]
    got = passages.repeats(docs(spark, [*ODD, *rows], extra=True)).collect()
    by = {r["doc_id"]: r for r in got}
    for k in range(100, 130):
        assert by[k]["start_word"] <= 40 + 3 and by[k]["start_word"] + by[k]["n_words"] >= 110 - 3 and by[k]["n_words"] < 90
        assert by[k]["first"] == (k == 100)
    assert 250 in by and 251 in by and not by[251]["first"]
    assert 260 not in by and 261 not in by
    assert by[8]["n_words"] == 120 and not by[8]["first"] and by[7]["first"]
    assert passages.repeats(docs(spark, [])).count() == 0


def test_every_context_of_a_key_is_kept_from_batch_to_batch(spark):
    rows = [(7, k, 0, k % 900) for k in range(2700)]
    table = spark.createDataFrame(rows, "key long, doc long, at int, beside int").coalesce(1).sortWithinPartitions("key", "doc", "at")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        links = table.mapInPandas(passages._meet, "key long, a long, at_a int, b long, at_b int, mark int, part int").where("mark = 0").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = {(r["a"], r["b"]) for r in links}
    assert got == {(k, k % 900) for k in range(900, 2700)} | {(k, 0) for k in range(1, 2700)}


def test_passage_whose_keys_stand_in_other_texts_too(spark):
    """Every n-gram by which the passage is found is frequent, in a context of its own before and between the copies."""
    said = prose(500, 55).split()
    w = passages.C.words_of([" ".join(said)])[0]
    seeds = [pow(0xC2B2AE3D27D4EB4F, k + 2, 1 << 64) for k in range(4)]
    at = sorted(set(passages.compact_windows(w, passages.np.array([0, len(w)]), 5, 46, passages.np.array(seeds, dtype=passages.np.uint64))[2].tolist()))

    def other(k):
        return " ".join(f"{prose(20000 + 100 * k + j, 50)} {' '.join(said[x : x + 5])} {prose(60000 + 100 * k + j, 50)}" for j, x in enumerate(at))

    rows = [(k, other(k)) for k in (*range(40), *range(51, 90))]
    rows += [(k, f"{prose(900 + k, 60)} {' '.join(said)} {prose(950 + k, 60)}") for k in (50, 90)]
    got = {r["doc_id"]: r for r in passages.repeats(docs(spark, rows)).collect()}
    assert set(got) == {50, 90}
    assert got[50]["first"] and not got[90]["first"]
    assert all(r["start_word"] <= 60 and r["start_word"] + r["n_words"] >= 115 for r in got.values())


def test_passages_that_end_with_a_frequent_line(spark):
    """Two copies of a few words and a frequent line, which unrelated documents of lesser ids have too, and after which all go on otherwise."""
    line = prose(700, 41)
    rows = [(k, f"{prose(30000 + k, 60)} {line} {prose(31000 + k, 60)}") for k in range(30)]
    rows += [(100 * c + k, f"{prose(32000 + k, 11)} {line} {prose(33000 + 100 * c + k, 60)}") for c in (1, 2) for k in range(40)]
    got = {r["doc_id"]: r for r in passages.repeats(docs(spark, rows)).collect()}
    assert set(got) == {100 * c + k for c in (1, 2) for k in range(40)}
    assert all(got[100 + k]["first"] and not got[200 + k]["first"] for k in range(40))


def test_others_by_brute_force():
    """Contexts under a few keys, as edited copies of some and at the ends of texts; each window that another document has is found, and in a lesser one."""
    np, rng = passages.np, random.Random(9)
    rows = []
    for key in range(12):
        line = [rng.randrange(10**6) for _ in range(30)]
        kinds = [[rng.randrange(10**6) for _ in range(20)] + line + [rng.randrange(10**6) for _ in range(19)] for _ in range(6)]
        for doc in range(rng.randrange(3, 60)):
            said = list(rng.choice(kinds))
            for _ in range(rng.choice((0, 0, 3, 6, 12))):
                said[rng.randrange(69)] = rng.randrange(10**6)
            if rng.randrange(3) == 0:
                said.insert(rng.randrange(69), said.pop(rng.randrange(69)))
            rows.append((key, doc // 2, said, rng.choice((0, 0, 7)), rng.choice((69, 69, 60))))
    key, doc, grams, begin, end = (np.array(x) for x in zip(*rows, strict=True))
    grams = grams.astype(np.uint32)
    links = [(int(x), int(y)) for xs, ys in passages._others(key, doc, grams, begin, end, 46, 0.8) for x, y in zip(xs, ys)]

    def windows(x, y):
        for i in range(24):
            if i >= max(begin[x], begin[y]) and i + 46 <= min(end[x], end[y]):
                common = sum((Counter(grams[x, i : i + 46].tolist()) & Counter(grams[y, i : i + 46].tolist())).values())
                if common >= 0.8 * (92 - common) - 1e-9:
                    yield i

    def seen(pairs):
        return {(x, i, doc[y] < doc[x]) for x, y in pairs for i in windows(x, y)}

    both = [(x, y) for x in range(len(rows)) for y in range(len(rows)) if key[x] == key[y] and doc[x] != doc[y]]
    want, got = seen(both), seen({z for x, y in links for z in ((x, y), (y, x))})
    first = {(x, i) for x, i, lesser in want if lesser}
    assert {(x, i) for x, i, lesser in got if lesser} == first and {(x, i) for x, i, _ in got} == {(x, i) for x, i, _ in want}
    assert len(first) > 500 and len({(x, i) for x, i, _ in want} - first) > 20 and len(links) < len(both) // 4


def test_others_of_lines_said_over_and_over():
    """A line of a few words many times over, that texts enter and leave at other places: each window is found, by few links."""
    np, rng = passages.np, random.Random(9)
    line = [rng.randrange(10**6) for _ in range(9)]
    rows = []
    for doc in range(300):
        foreign = [10**6 + 69 * doc + k for k in range(69)]
        enter, leave = rng.randrange(24), 69 - rng.randrange(24)
        rows.append([line[k % 9] if enter <= k < leave else foreign[k] for k in range(69)])
    grams, n = np.array(rows, dtype=np.uint32), len(rows)
    key, zero = np.zeros((2, n), dtype=np.int64)
    links = [(int(x), int(y)) for xs, ys in passages._others(key, np.arange(n), grams, zero, zero + 69, 46, 0.8) for x, y in zip(xs, ys)]
    said = sorted(set(line))
    own = np.array([[[w.count(g) for g in said] for w in (x[i : i + 46] for i in range(24))] for x in rows])  # foreign words stand in one text alone

    def seen(pairs):
        return {(x, i, y < x) for x, y in pairs for i in np.flatnonzero(np.minimum(own[x], own[y]).sum(axis=1) >= 41).tolist()}

    want = seen((x, y) for x in range(n) for y in range(n) if x != y)
    got = seen(z for x, y in links for z in ((x, y), (y, x)))
    assert {z for z in want if z[2]} <= got and {z[:2] for z in want} == {z[:2] for z in got}
    assert len(links) < 1.4 * n


def test_windows_are_those_of_brute_force():
    """Lines that repeat within a stretch, edits and shifts, against multisets of n-grams."""
    np, rng = passages.np, random.Random(4)
    line = [rng.randrange(10**6) for _ in range(20)]
    text = [g for _ in range(6) for g in (*line, *(rng.randrange(10**6) for _ in range(35)))]
    both, sizes, want = [], [], set()
    both.append((text, text))
    for k in range(20):
        other = list(text)
        for _ in range(rng.randrange(60)):
            at = rng.randrange(len(other) - 3)
            if rng.randrange(2):
                other[at : at + 3] = other[at : at + 3][::-1]
            else:
                other[at] = rng.choice(text)
        if k % 3:
            other.insert(rng.randrange(len(other)), 7)
        both.append((text, other[: len(text)]))
    both.append((text[:45], text[:45]))
    seen, before = Counter(), 0
    for a, b in both:
        for i in range(len(a) - 45):
            common = sum((Counter(a[i : i + 46]) & Counter(b[i : i + 46])).values())
            hit = common >= 0.8 * (92 - common) - 1e-9
            seen[hit] += 1
            if hit:
                want.add(before + i)
        sizes.append(len(a))
        before += len(a)
    a, b = (np.array([g for pair in both for g in pair[k]], dtype=np.uint32) for k in (0, 1))
    assert set(passages._hits(a, b, np.array(sizes), 46, 0.8).tolist()) == want
    assert min(seen[True], seen[False]) > 20


def test_short_lines_are_those_of_brute_force(spark):
    """Lines of 1 to 23 characters, by edits and by their classes."""
    rng, kinds = random.Random(6), {"a", "zz"}
    for _ in range(60):
        base = "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(3, 24)))
        kinds |= {base, base[:-1] + "z", "y" + base[:22]}
    kinds = sorted(kinds)
    root = {x: x for x in kinds}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(kinds):
        for y in kinds[:i]:
            if len(x) > 2 and len(y) > 2 and distance(x, y) <= 2:
                root[find(x)] = find(y)
    got = {kinds[r["doc_id"]]: r["class_id"] for r in lines.classes(docs(spark, list(enumerate(kinds)))).collect()}
    pairs = {(find(x), got[x]) for x in kinds}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) < len(kinds) / 2


def test_crowded_lines_are_those_of_brute_force(spark):
    """Families of edited lines that share segments: crowded keys are split until they are small."""
    rng, kinds = random.Random(8), set()
    for length in (9, 40):
        base = "".join(rng.choice("abcdefgh ") for _ in range(length))
        for _ in range(40):
            x = base
            for _ in range(rng.randrange(5)):
                at = rng.randrange(len(x))
                kind = rng.randrange(3)
                x = x[:at] + ("" if kind == 2 else rng.choice("é𝒳yz")) + x[at + (kind > 0) :]
            kinds.add(x)
        kinds |= {f"{base}{k:04d}" for k in range(0, 3000, 97)}
    kinds |= {a + b + c for a in "ab" for b in "xyz0123456" for c in "mn"}
    kinds = sorted(x for x in kinds if len(x) > 2)
    table = spark.createDataFrame([(k, len(x), x) for k, x in enumerate(kinds)], "id long, n int, line string")
    rows = [(i, j) for i in range(len(kinds)) for j in range(i + 1, len(kinds)) if abs(len(kinds[i]) - len(kinds[j])) <= 2]
    want = {(i, j) for i, j in rows if distance(kinds[i], kinds[j]) <= 2}
    assert want == {tuple(r) for r in lines.links(table, 2, crowd=3).collect()}
