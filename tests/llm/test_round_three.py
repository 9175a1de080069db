"""Operators 11 to 13 against brute force, with their edge cases."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from ordeval.llm import structure, substrings, vectorcodes

# --- 11: substrings ------------------------------------------------------------------------------------------------


def brute_removal(rows):
    """(doc_id, n_words, n_removed, digest) of each row, by looking every window up."""
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, w in words:
        for p in range(len(w) - 49 if d is not None else 0):
            key = tuple(w[p : p + 50])
            least[key] = min(least.get(key, d), d)
    out = []
    for d, w in words:
        gone = set()
        for p in range(len(w) - 49 if d is not None else 0):
            if least[tuple(w[p : p + 50])] < d:
                gone.update(range(p, p + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest(), kept))
    return sorted(out, key=str)


def passages(rng, n, vocabulary):
    """Documents that share passages of 40 to 120 words, with edits, copies, and repetitions within."""
    pool = [[rng.choice(vocabulary) for _ in range(rng.randint(40, 120))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.6:
                p = list(rng.choice(pool))
                if rng.random() < 0.5:
                    p[rng.randrange(len(p))] = "edited"
                w += p[rng.randint(0, 5) : len(p) - rng.randint(0, 5)]
            else:
                w += [rng.choice(vocabulary) for _ in range(rng.randint(1, 60))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(n + i, rng.choice(rows)[1]) for i in range(n // 5)]
    rng.shuffle(rows)
    return rows


DOCS = "doc_id long, text string, h long, start string, factors int, cut_id int"


def documents(spark, rows):
    """Extra columns whose names clash with what the operator adds."""
    return spark.createDataFrame([(d, t, 1, "s", 2, 3) for d, t in rows], DOCS)


@pytest.mark.parametrize("vocabulary, piece", [(400, 1 << 19), (2, 1 << 19), (400, 37), (2, 64)])
def test_substrings_equal_brute_force(spark, vocabulary, piece):
    rng = random.Random(vocabulary + piece)
    rows = passages(rng, 40, [f"w{i}" for i in range(vocabulary)])
    rows += [(None, rows[0][1]), (None, None), (3, rows[1][1]), (3, rows[1][1]), (900, None), (901, ""), (902, " \n "), (903, "x " * 3000), (904, "x " * 2000)]
    want = brute_removal(rows)
    docs = documents(spark, rows)
    assert sorted(map(tuple, substrings.removal_digest(docs, piece=piece).collect()), key=str) == sorted((w[:4] for w in want), key=str)
    assert sum(w[2] for w in want) > 1000


def test_substrings_texts_and_edges(spark):
    rng = random.Random(5)
    rows = passages(rng, 20, [f"w{i}" for i in range(300)])
    docs = documents(spark, rows)
    left = substrings.without_repeats(docs)
    assert left.columns == docs.columns
    cut = {w[0]: w[4] for w in brute_removal(rows) if w[2]}
    given = dict(rows)
    assert {r["doc_id"]: r["text"] for r in left.collect()} == given | cut and cut
    empty = documents(spark, [])
    assert substrings.removal_digest(empty).count() == 0 and substrings.without_repeats(empty).count() == 0


def test_substrings_of_a_passage_that_all_share(spark):
    """One passage in every document, with other words around it: only its first holder keeps it."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"a{i} b{i} {passage} c{i}") for i in range(300)]
    got = {r["doc_id"]: r["n_removed"] for r in substrings.removal_digest(documents(spark, rows)).collect()}
    assert got == {i: 60 * (i > 0) for i in range(300)}


def test_substrings_factors_grow():
    assert substrings.grown(iter([(0, 0b111), (3, 0b1), (100, 0b1001)])) == [(0, 53), (100, 153)]
    assert substrings.grown(iter([(0, 0b1), (60, (1 << 60) | 1)])) == [(0, 50), (60, 110), (120, 170)]


# --- 12: vector codes ----------------------------------------------------------------------------------------------


def brute_codes(vectors, parts, entries, rounds):
    """Codes, errors and codebooks by all distances."""
    x = np.floor(np.array(vectors, float) * 256).astype(np.int64)
    p = x.reshape(len(x), parts, -1).transpose(1, 0, 2)
    book = p[:, :entries].copy()
    for k in range(rounds + 1):
        far = ((p[:, :, None, :] - book[:, None, :, :]) ** 2).sum(3)
        near = far.argmin(2)
        if k < rounds:
            for i in range(parts):
                for e in range(book.shape[1]):
                    own = p[i][near[i] == e]
                    if len(own):
                        book[i, e] = [int(v) // len(own) for v in own.sum(0)]
    return near, far.min(2).sum(0), ",".join(map(str, book.ravel().tolist()))


VECTORS = "vec_id long, embedding array<float>, label int, x string, code long, error string, of int"


@pytest.mark.parametrize("spread, width", [(0.3, 64), (0.01, 32), (3.0, 16), (60.0, 48)])
def test_codes_equal_brute_force(spark, spread, width):
    rng = np.random.default_rng(7)
    vectors = (rng.standard_normal((700, width)) * spread).astype(np.float32)
    vectors[300:400] = vectors[:100]  # ties and repeated vectors
    labels = [None if i % 5 == 0 else i % 3 for i in range(len(vectors))]
    rows = [(i, v.tolist(), k, "a", 1, "b", 2) for i, (v, k) in enumerate(zip(vectors, labels, strict=True))]
    bad = [(-1, None, 1, "", 0, "", 0), (-2, [], 1, "", 0, "", 0), (-3, [float("nan")] * width, 1, "", 0, "", 0), (-4, [None] + [0.0] * (width - 1), 1, "", 0, "", 0), (-5, [float("-inf")] * width, 1, "", 0, "", 0)]
    got = {r["vec_id"]: r for r in vectorcodes.compress(spark.createDataFrame(rows + bad, VECTORS).repartition(3)).collect()}
    near, error, book = brute_codes(vectors, 16, 64, 2)
    by_label = {}
    for k, e in zip(labels, error.tolist(), strict=True):
        by_label[k] = by_label.get(k, 0) + e
    assert len(got) == len(rows)
    for i in range(len(rows)):
        assert got[i]["code"] == "".join(f"{e:02x}" for e in near[:, i]) and got[i]["error"] == error[i]
        assert got[i]["label_error"] == by_label[labels[i]]
        assert got[i]["codebooks_sha256"] == hashlib.sha256(book.encode()).hexdigest()


def test_cells_keep_every_nearest_entry():
    """Whatever the cell's size and however often the memory is cleared, nothing nearest is dominated; ties go low."""
    rng = np.random.default_rng(3)
    for cell, memo in ((1, 0), (7, 10), (32, 1 << 20), (100, 5)):
        entries = rng.integers(-200, 200, (64, 3))
        entries[40] = entries[7]
        cells = vectorcodes.Cells(entries, cell, memo)
        for _ in range(3):
            parts = np.concatenate([rng.integers(-300, 300, (2000, 3)), entries])
            far = ((parts[:, None, :] - entries) ** 2).sum(2)
            entry, distance = cells.nearest(parts)
            assert (entry == far.argmin(1)).all() and (distance == far.min(1)).all()
        if cell == 32:
            assert np.mean([len(x) for x in cells.known.values()]) < 32


def test_codes_edges(spark):
    make = lambda rows: spark.createDataFrame([(i, v, k, "a", 1, "b", 2) for i, v, k in rows], VECTORS)
    assert vectorcodes.compress(make([])).count() == 0
    few = vectorcodes.compress(make([(None, [0.5] * 16, None), (1, [0.25] * 16, 1), (1, [0.25] * 16, 1)])).collect()
    assert sorted((r["vec_id"] or 0, r["code"], r["error"]) for r in few) == [(0, "02" * 16, 0), (1, "00" * 16, 0), (1, "00" * 16, 0)]
    assert vectorcodes.compress(make([(1, [0.5] * 16, 1), (2, [0.5] * 32, 1)])).count() == 1
    with pytest.raises(ValueError, match="equal parts"):
        vectorcodes.compress(make([(1, [0.5] * 17, 1)]))


# --- 13: structure -------------------------------------------------------------------------------------------------


def brute_damage(rows):
    said = {}
    for conv, turn, role, text in rows:
        own = said.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        own += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return said


def brute_repair(rows):
    """Cheapest edits by a search over all audits in order of cost, then ASCII."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        core = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {r[0] for r in rows} - {None}
    out = {c: faults.count(c) for c in ("blank", "duplicate", "truncated")}
    out["gaps"] = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    out["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    queue, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, initials, said = heapq.heappop(queue)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return out | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(said).encode()).hexdigest()}
        if (i, initials[-1:]) in done:
            continue
        done.add((i, initials[-1:]))
        ways = [(2, "I", i, role, "") for role in ("user", "assistant")]
        if i < len(rows):
            ways.append((3, "D", i + 1, None, None))
            if faults[i] in ("", "truncated"):
                more = faults[i] == "truncated"
                ways += [(more, "K", i + 1, rows[i][1], rows[i][2])] + [(2 + more, "R", i + 1, role, rows[i][2]) for role in ("user", "assistant")]
        for price, letter, j, role, text in ways:
            then = initials if role is None else initials + (role[:1] or " ")
            if role is None or re.fullmatch("s?(ua)*u?", then):
                heapq.heappush(queue, (cost + price, audit + letter, j, then, said + (() if role is None else (f"{role}:{text}",))))


TURNS = "conv_id long, turn long, role string, text string, digest int, audit string, copies int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "a", 2) for r in rows], TURNS)


def some_conversations(rng, n):
    texts = ["Yes.", "No!", "cut off", "", " \n", "Why? ", "a.b", "é.", "again."]
    return [
        (c, t, rng.choice(["user", "assistant", "system", "tool", "", None]) if rng.random() < 0.4 else ("assistant" if t % 2 else "user"), rng.choice([*texts, f"t{t}.", None]))
        for c in range(n) for t in rng.sample(range(12), rng.randint(1, 9))
    ]


def test_structure_equals_brute_force(spark):
    rng = random.Random(13)
    rows = some_conversations(rng, 150)
    rows += [(None, None, "user", "Hi."), (None, 1, "assistant", "Ho."), (None, None, None, None), (500, None, "user", "a."), (500, None, "user", "b."), (500, 3, "assistant", "x" * 200_000 + ".")]
    rows += [(501, 7, "user", "same.")] * 5 + [(501, 8, "assistant", "so.")] * 3
    got = {r["conv_id"]: r.asDict() for r in structure.repair_digest(structure.repair(structure.damaged(turns(spark, rows)))).collect()}
    said = brute_damage(rows)
    assert set(got) == set(said)
    for conv, own in said.items():
        assert got[conv] == brute_repair(own) | {"conv_id": conv}, conv
    assert any(not own for own in said.values()) and len({r["audit"] for r in got.values()}) > 50


def test_structure_of_undamaged_rows_and_edges(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Why?"), (1, 2, "assistant", "So."), (2, 0, "assistant", "Hello."), (3, 0, "user", "")]
    repaired = structure.repair(structure.given_rows(turns(spark, rows))).where("position > 0").orderBy("conv_id", "position").collect()
    assert [(r["conv_id"], r["edit"], r["role"], r["text"]) for r in repaired] == [
        (1, "K", "system", "Be brief."), (1, "K", "user", "Why?"), (1, "K", "assistant", "So."), (2, "I", "user", ""), (2, "K", "assistant", "Hello."),
    ]
    assert structure.repair_digest(structure.repair(structure.damaged(turns(spark, [])))).count() == 0


def test_one_node_for_each_suffix(monkeypatch):
    made = []
    real = structure.node_before
    monkeypatch.setattr(structure, "node_before", lambda symbol, after: made.append(symbol) or real(symbol, after))
    rng = random.Random(2)
    signatures = {"".join(rng.choice("suaxUAo") for _ in range(rng.randint(0, 7))) for _ in range(500)}
    found = list(structure.audits(iter(sorted(s[::-1] for s in signatures))))
    assert len(found) == len(signatures)
    assert len(made) == len({s[i:] for s in signatures for i in range(len(s))})


# --- changes to earlier operators ----------------------------------------------------------------------------------


def test_mix_does_not_depend_on_the_number_of_ranges(spark, monkeypatch):
    """More ranges, as a larger table has, change the plan and nothing else; null ids and equal rows are dealt like others."""
    from ordeval.llm import mixing

    rng = random.Random(9)
    rows = [(None if i % 4 == 0 else i % 150, " ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.randint(1, 4))), rng.choice(["a", "b", None])) for i in range(600)]
    rows += [(7, "same text", "a")] * 95 + [(None, "same text", "b")] * 50
    docs = spark.createDataFrame([(d, t, s, 0) for d, t, s in rows], "doc_id long, text string, source string, key int")
    wanted = None
    for ranges, equal in ((1, 10_000), (256, 10_000), (5000, 7)):
        monkeypatch.setattr(mixing, "RANGES", ranges)
        monkeypatch.setattr(mixing, "EQUAL_ROWS", equal)
        got = sorted(map(tuple, mixing.systematic_mix(docs).collect()), key=str)
        wanted = wanted or got
        assert got == wanted and len(got) == len(rows)


def test_pictures_in_blocks(monkeypatch):
    """Blocks of any height give the same picture and the same values, and all filters reach over their edges."""
    import zlib as z

    from ordeval.llm import media

    rng = np.random.default_rng(2)
    whole = media.padded((b"some text of lines \n" * 3000 + rng.integers(0, 256, 40_000, dtype=np.uint8).tobytes()))
    rows = np.frombuffer(whole, np.uint8).reshape(-1, 576)
    png, read = media.encode_png(whole), media.read_features(media.encode_png(whole))
    for block in (1, 2, 7, 50):
        monkeypatch.setattr(media, "BLOCK", block)
        assert media.encode_png(whole) == png and media.read_features(png) == read
        assert (media.decode_png(png) == rows).all()
    assert read[0] == len(whole) and read[1] == hashlib.sha256(whole).hexdigest() and read[2] == z.crc32(whole[-32:]) and read[4] is None
    monkeypatch.setattr(media, "BLOCK", 3)
    small = rng.integers(0, 256, (10, 5), dtype=np.uint8)
    kinds = [4, 3, 2, 1, 4, 0, 3, 4, 2, 4]
    lines = []
    for y, kind in enumerate(kinds):
        above = small[y - 1].astype(int) if y else np.zeros(5, int)
        line = [kind]
        for x in range(5):
            left, corner = (int(small[y, x - 1]), int(above[x - 1])) if x else (0, 0)
            p = left + int(above[x]) - corner
            near = min((abs(p - left), 0, left), (abs(p - int(above[x])), 1, int(above[x])), (abs(p - corner), 2, corner))[2]
            line.append((int(small[y, x]) - [0, left, int(above[x]), (left + int(above[x])) // 2, near][kind]) % 256)
        lines.append(bytes(line))
    head = media.struct.pack(">IIBBBBB", 5, 10, 8, 0, 0, 0, 0)
    data = z.compress(b"".join(lines))
    made = media.SIGNATURE + b"".join(media._chunk(k, d) for k, d in ((b"IHDR", head), *((b"IDAT", data[i : i + 9]) for i in range(0, len(data), 9)), (b"IEND", b"")))
    assert (media.decode_png(made) == small).all()
    with pytest.raises(media.BadPicture):
        media.decode_png(made.replace(b"IEND", b"IENX"))


def test_a_picture_takes_little_more_than_its_payload():
    import tracemalloc

    from ordeval.llm import media

    payload = media.padded(np.random.default_rng(1).integers(97, 123, 1 << 26, dtype=np.uint8).tobytes())
    tracemalloc.start()
    png = media.encode_png(payload)
    read = media.read_features(png)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert read[0] == len(payload) and read[4] is None
    assert peak < 3 * len(payload)  # besides the payload: with it below 4


def test_grid_means_equal_plain_ones():
    from ordeval.llm import media

    rng = np.random.default_rng(6)
    for height, width in ((1, 576), (31, 576), (32, 32), (33, 40), (500, 576), (70, 5)):
        rows = rng.integers(0, 256, (height, width), dtype=np.uint8)
        grid = media.Averages(height, width)
        for y in range(0, height, 9):
            grid.add(rows[y : y + 9])
        plain = np.zeros((32, 32))
        for i in range(32):
            for j in range(32):
                a, b = i * height // 32, max((i + 1) * height // 32, i * height // 32 + 1)
                c, d = j * width // 32, max((j + 1) * width // 32, j * width // 32 + 1)
                plain[i, j] = rows[a:b, c:d].mean()
        assert np.allclose(grid.means(), plain, atol=1e-9), (height, width)


def test_whole_license_texts_are_found(spark, monkeypatch):
    from ordeval.llm import licenses

    rng = random.Random(17)
    noise = lambda n: " ".join(f"n{rng.randint(0, 999)}" for _ in range(n))
    edited = licenses.TEMPLATES["BSD-3-Clause-text"].split()
    for at in (20, 90, 170):
        edited[at] = "edited"
    half = " ".join(licenses.TEMPLATES["MIT-text"].split()[:80])
    rows = [
        (1, f"{noise(700)} {licenses.TEMPLATES['MIT-text']} {noise(900)}"), (2, f"{noise(5)} {' '.join(edited)}"), (3, f"{noise(3)} {half} {noise(400)}"),
        (4, noise(3000)), (5, licenses.TEMPLATES["GNU-notice"].upper() + noise(10)), (6, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def found():
        out = {}
        for r in licenses.scan_licenses(docs).collect():
            out.setdefault(r["doc_id"], {})[r["license_id"]] = r["containment"]
        return out

    got = found()
    assert got[1]["MIT-text"] == 1.0 and got[1]["MIT-grant"] == 1.0
    assert 0.8 <= got[2]["BSD-3-Clause-text"] < 1.0 and "BSD-2-Clause-text" not in got[2]  # siblings are told apart
    assert set(got[3]) == {"MIT-grant"} and 4 not in got and 6 not in got
    assert got[5]["GNU-notice"] == 1.0
    monkeypatch.setattr(licenses, "MOST", 10)  # beyond it templates are joined by a shuffle
    assert found() == got


def test_many_long_templates_cost_no_literals(spark):
    from ordeval.llm import licenses

    rng = random.Random(18)
    texts = {f"T{i}": " ".join(f"v{rng.randint(0, 3000)}" for _ in range(300)) for i in range(120)}
    docs = spark.createDataFrame([(i, f"before {texts[f'T{i}']} after") for i in range(0, 120, 7)] + [(500, "v1 v2 v3")], "doc_id long, text string")
    got = {(r["doc_id"], r["license_id"]) for r in licenses.scan_licenses(docs, texts).collect()}
    assert got == {(i, f"T{i}") for i in range(0, 120, 7)}


def test_toxicity_scores_are_the_same_for_any_partitions(spark):
    from tests.llm.test_operators import learned_tables

    from ordeval.llm import toxicity

    _, docs, labels = learned_tables(spark)
    runs = [sorted(tuple(r) for r in toxicity.toxicity_of(docs.repartition(n), labels.repartition(n)).collect()) for n in (2, 7)]
    assert runs[0] == runs[1]


def plain_depth(forest, row):
    """A row's mean path length, one comparison after the other."""
    total = 0.0
    for feature, cut, right, path in forest.trees:
        at = 0
        while feature[at] >= 0:
            at = at + 1 if row[feature[at]] < cut[at] else right[at]
        total += path[at]
    return total / len(forest.trees)


def plain_cut(depths, good, loss):
    """The threshold by trying every depth: most bad rows below it less good ones, few enough of these; the last of equals,
    moved half way towards the nearest good row that stays."""
    best, found = None, 0.0
    kept, lost = [d for d, g in zip(depths, good, strict=True) if g], [d for d, g in zip(depths, good, strict=True) if not g]
    for cut in sorted(set(depths)):
        away = sum(d < cut for d in kept) / len(kept)
        if away > loss:
            break
        gain = sum(d < cut for d in lost) / len(lost) - away
        if gain >= found:
            best, found = cut, gain
    return (best + min((d for d in kept if d >= best), default=best)) / 2


def test_quality_verdicts_equal_plain_ones(spark):
    from ordeval.llm import quality

    rng = random.Random(23)
    rows, marks = [], []
    for i in range(240):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(30, 120))]
        bad = i % 4 == 3
        rows.append((i, " ".join(f"{w.upper()}%%" if bad and rng.random() < 0.7 else w for w in words)))
        marks.append((i, int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = quality.QualityModel.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality.quality_verdicts(docs, labels).collect()}
    measured = quality._measured([t for _, t, *_ in rows])
    x = quality.features(measured)
    depths = {d: plain_depth(model.forest, f) for (d, *_), f in zip(rows, x, strict=True)}
    for (d, *_), n, repeated in zip(rows, measured["n_words"], measured["n_repeat_words"], strict=True):
        failed = n < 50 or 100 * repeated > 50 * n
        assert got[d]["base_failed"] == failed and got[d]["depth"] == pytest.approx(depths[d])
        assert got[d]["kept"] == (not failed and depths[d] >= model.cut)
    assert {r["kept"] for r in got.values()} == {True, False}
    rng = np.random.default_rng(1)
    for _ in range(30):
        d = np.round(np.concatenate([rng.normal(6, 1, 200), rng.normal(4, 1, 40)]), 2)
        good = np.arange(240) < 200
        assert quality.calibrated(d, good, 0.05) == pytest.approx(plain_cut(d.tolist(), good.tolist(), 0.05))


def test_threshold_of_rows_equals_that_of_arrays(spark):
    from ordeval.llm import quality

    rng = np.random.default_rng(2)
    for loss in (0.002, 0.05, 0.2):
        d = np.round(np.concatenate([rng.normal(6, 1, 200), rng.normal(4, 1, 40)]), 2)
        good = np.arange(240) < 200
        rows = spark.createDataFrame([(float(x), int(g)) for x, g in zip(d, good, strict=True)], "depth double, good int")
        assert quality.calibrated_rows(rows, loss) == pytest.approx(quality.calibrated(d, good, loss))
    assert quality.calibrated_rows(rows.where("good = 1")) == -np.inf == quality.calibrated_rows(rows.where("good = 0"))


def test_models_learn_from_every_labelled_row(spark, monkeypatch):
    """More rows than the samples of before: the last ones count, too."""
    from pyspark.sql import functions as F

    from ordeval.llm import language, quality

    seen = {}
    monkeypatch.setattr(quality, "calibrated_rows", lambda known, loss=0: seen.setdefault("n", known.count()) * 0.0)
    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.concat(F.lit("w"), (F.col("id") * 7 + i).cast("string"))), " ").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 12 != 0).cast("int").alias("quality"))
    quality.QualityModel.fit(docs, labels)
    half = sum(r[0] for r in labels.where("quality = 1").select(F.pmod(F.xxhash64("doc_id", F.lit(quality.SEED)), F.lit(2))).collect())
    assert seen["n"] == half + 2_000
    rows = spark.range(12_000).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text"), F.lit("x").alias("lang"))
    counts = language.learned_counts(rows).collect()
    model = language.NaiveBayes.fit(rows.unionByName(rows.where("doc_id < 10").withColumn("lang", F.lit("y"))))
    n = np.full(language.BUCKETS, language.SMOOTHING)
    for r in counts:
        n[r["bucket"]] += r["n"]
    assert max(r["n"] for r in counts) >= 12_000 and np.allclose(model.logs[:, 0], np.log(n / n.sum()), atol=1e-6)
