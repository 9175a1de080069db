"""Each operator on small tables against brute force, exact round trips or known answers, with its edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from ordeval.llm import chat, language, licenses, media, mixing, neardup, packing, pii, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, id string"
WORDS = [f"w{i}" for i in range(400)]


def table(spark, rows):
    """Documents with extra columns whose names clash with what operators add."""
    full = [(d, t, lang, s, None if t is None else len(t), "x", "y") for d, t, lang, s in rows]
    return spark.createDataFrame(full, DOCS)


EDGES = [(1, None, None, None), (2, "", "en", "a"), (None, "one two", "en", "a"), (4, " \n\t ", "en", None), (5, "x " * 30000, "en", "b")]


def some_text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# --- 1: mixing -----------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing_targets_and_copies(spark):
    rng = random.Random(3)
    rows = [(i, some_text(rng, rng.randint(1, 60)), "en", rng.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(600)]
    got = mixing.systematic_mix(table(spark, rows)).collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    target = brute_targets(sizes)
    assert len(got) == 600
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert own[0]["source_size"] == sizes[s] and own[0]["target"] == pytest.approx(target[s], rel=1e-12)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= 60  # the longest document
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.systematic_mix(table(spark, rows)).collect()), key=str)


def test_mixing_edges(spark):
    got = {r["id"]: r for r in mixing.systematic_mix(table(spark, EDGES)).collect()}
    assert len(got) == 5 and got[1]["size"] == 0 and got[5]["taken"] <= 60000
    assert mixing.systematic_mix(table(spark, [])).count() == 0
    same = table(spark, [(7, "a b", "en", "s")] * 3)
    assert mixing.systematic_mix(same).count() == 3
    docs = table(spark, [(i, "a b c", "en", "s") for i in range(10)])
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() in (14, 15, 16)


def test_mixing_of_repeated_rows_is_what_the_query_takes(spark):
    rng = random.Random(41)
    rows = [(i % 20, f"t{i % 23} " * (1 + i % 7), "en", rng.choice(["a", "b", None])) for i in range(300)] + [(None, "x y", "en", "a")] * 30
    docs = table(spark, rows).withColumnsRenamed({"size": "mix_copies", "id": "__copy"})
    want, got = {}, {}
    for r in mixing.systematic_mix(docs).collect():
        key = (r["id"], r["source"], r["size"])
        want[key] = want.get(key, 0) + r["copies"]
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        key = (r["doc_id"], r["source"], len((r["text"] or "").split()))
        got[key] = got.get(key, 0) + 1
    assert got == {k: n for k, n in want.items() if n}


# --- 2: packing ----------------------------------------------------------------------------------------------------


def brute_pack(rows, capacity, per_source):
    """Best fit by looking at every bin."""
    bins = []
    placed = {}
    for doc, size, source, cluster in sorted(rows, key=lambda r: (-r[1], r[0])):
        fits = [
            (b["left"], i) for i, b in enumerate(bins)
            if b["left"] >= size and cluster not in b["clusters"] and b["sources"].count(source) < per_source
        ]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"left": capacity, "clusters": set(), "sources": []})
        bins[i]["left"] -= size
        bins[i]["clusters"].add(cluster)
        bins[i]["sources"].append(source)
        placed[doc] = i
    return placed


def test_packing_is_best_fit(spark):
    rng = random.Random(5)
    rows, seen = [], []
    for i in range(300):
        text = rng.choice(seen) if seen and rng.random() < 0.3 else some_text(rng, rng.randint(1, 50))
        seen.append(text)
        rows.append((i, text, "en", rng.choice("aab")))
    got = packing.best_fit_pack(table(spark, rows), capacity=64, per_source=2).collect()
    want = brute_pack([(d, len(t.split()), s, t) for d, t, _, s in rows], 64, 2)
    assert {r["doc_id"]: r["bin"] for r in got} == want
    by_bin = {}
    for r in got:
        by_bin.setdefault(r["bin_id"], []).append(r)
    for members in by_bin.values():
        at = 0
        for r in sorted(members, key=lambda r: (r["bin_start"], r["n_words"])):
            assert r["bin_start"] == at
            at += r["n_words"]
        assert at <= 64


def test_packing_fills_bins_of_few_sources(spark):
    docs = table(spark, [(i, f"a{i} b c d", "en", "s") for i in range(3000)])
    bins = packing.filled(packing.best_fit_pack(docs)).collect()
    assert sum(b["n_words"] for b in bins) == 12000 and len(bins) == 3
    empty = packing.best_fit_pack(table(spark, [(None, "", "en", "s")] * 9000)).collect()
    shards = {}
    for r in empty:
        shards[r["shard"]] = shards.get(r["shard"], 0) + 1
    assert len(empty) == 9000 and len(shards) == 3 and max(shards.values()) < 4000


def test_packed_texts_are_the_documents(spark):
    rng = random.Random(51)
    rows = [(i % 30, "".join(rng.choice([" ", "\n", "a ", "bé\t", "c  "]) for _ in range(rng.randint(0, 90))), "en", "s") for i in range(60)]
    rows += [*EDGES, rows[0], rows[0]]
    got = packing.packed_texts(table(spark, rows), capacity=16).collect()
    assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) == r["n_words"] for r in got)
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["text_hash"]), {}).setdefault(r["part"], []).append(r["text"])
    texts = sorted((str(d), "".join(parts[k][0] for k in sorted(parts))) for (d, _), parts in by.items() for _ in parts[0])
    assert texts == sorted((str(d), t or "") for d, t, *_ in rows)


def test_packing_edges(spark):
    got = packing.best_fit_pack(table(spark, EDGES), capacity=4096).collect()
    long = sorted((r["part"], r["start_word"], r["n_words"]) for r in got if r["doc_id"] == 5)
    assert sum(n for *_, n in long) == 30000 and [s for _, s, _ in long] == [4096 * k for k in range(8)]
    assert {r["doc_id"] for r in got} == {1, 2, None, 4, 5}
    assert packing.best_fit_pack(table(spark, [])).count() == 0
    copies = packing.best_fit_pack(table(spark, [(9, "a b", "en", "s")] * 4)).collect()
    assert len({r["bin_id"] for r in copies}) == 4


# --- 3: media ------------------------------------------------------------------------------------------------------


def test_png_round_trip_and_damage():
    for n in (0, 1, 575, 576, 577, 90000):
        data = bytes((i * 7 + i // 50) % 256 for i in range(n))
        payload = media.padded(data)
        png = media.encode_png(payload)
        assert len(payload) % 576 == 0 and payload and media.decode_png(png).tobytes() == payload
        for at in (0, 20, len(png) // 2, len(png) - 6):
            bad = png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :]
            with pytest.raises(media.BadPicture):
                media.decode_png(bad)


def test_unfilter_knows_all_filters():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 256, (10, 40), dtype=np.uint8)
    lines = np.zeros((10, 41), np.uint8)
    for y in range(10):
        kind = y % 5
        lines[y, 0] = kind
        for x in range(40):
            a = int(rows[y, x - 1]) if x else 0
            b = int(rows[y - 1, x]) if y else 0
            c = int(rows[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            lines[y, x + 1] = (int(rows[y, x]) - (0, a, b, (a + b) // 2, near)[kind]) % 256
    assert (media._unfilter(lines, np.zeros(lines.shape[1] - 1, np.uint8)) == rows).all()


def test_malformed_headers_are_bad_pictures():
    png = media.encode_png(media.padded(b"abc"))
    head = png[16:29]
    packed = zlib.compress(b"\0" * 577)

    def made(*chunks):
        return media.SIGNATURE + b"".join(media._chunk(k, d) for k, d in chunks)

    good = (b"IDAT", packed), (b"IEND", b"")
    for heads in ([head[:12]], [head, head], [b""], [head[:4] + bytes(4) + head[8:]], [bytes(4) + head[4:]], [b"\xff" * 8 + head[8:]], [head[:8] + b"\x10" + head[9:]]):
        with pytest.raises(media.BadPicture):
            media.decode_png(made(*[(b"IHDR", h) for h in heads], *good))
    bomb = zlib.compress(b"\0" * 10_000_000)
    for data in (bomb, packed[:-5], b""):
        with pytest.raises(media.BadPicture):
            media.decode_png(made((b"IHDR", head), (b"IDAT", data), (b"IEND", b"")))
    assert media.decode_png(made((b"IHDR", head), *good)).shape == (1, 576)


def test_media_digest_and_columns(spark):
    rows = [*EDGES, (6, "né", "fr", "a"), (7, "né", "fr", "b")]
    got = {r["doc_id"]: r for r in media.text_media_digest(table(spark, rows)).collect()}
    for doc, text, *_ in rows:
        data = (text or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        r = got[doc]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
    assert got[6]["feature"] == got[7]["feature"] and got[6]["media_sha256"] == got[7]["media_sha256"]
    df = spark.createDataFrame([(1, b"abc"), (2, None)], "k int, payload binary")
    read = media.with_features(media.with_pictures(df, "payload")).select("k", "read.*").collect()
    assert all(r["payload_bytes"] == 576 and r["error"] is None for r in read)
    broken = media.with_features(spark.createDataFrame([(1, b"abc"), (2, None)], "k int, media binary")).select("read.*").collect()
    assert all(r["error"] and r["feature"] is None for r in broken)
    assert media.text_media_digest(table(spark, [])).count() == 0


# --- 4: near-duplicates --------------------------------------------------------------------------------------------


def brute_components(rows, k, threshold):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = set(zip(*(w[i:] for i in range(k)))) if len(w) >= k else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def family(rng, rows, size, length, changes):
    base = [rng.choice(WORDS) for _ in range(length)]
    for _ in range(size):
        words = list(base)
        for _ in range(rng.randint(0, changes)):
            words[rng.randrange(length)] = rng.choice(WORDS)
        rows.append((len(rows), " ".join(words).upper() if rng.random() < 0.2 else " ".join(words)))


@pytest.mark.parametrize(("k", "threshold"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, k, threshold):
    rng = random.Random(k)
    rows = []
    for _ in range(12):
        family(rng, rows, rng.randint(2, 9), rng.randint(3, 120), 6)
    family(rng, rows, 60, 150, 12)
    rows += [(len(rows) + i, some_text(rng, 40)) for i in range(40)]
    df = table(spark, [(d, t, "en", "s") for d, t in rows])
    want = brute_components(rows, k, threshold)
    for options in ({}, {"class_shingles": 2000}, {"class_shingles": 300}):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, k, threshold, **options).collect()}
        assert got == want, options


def test_near_duplicates_deep_regions(spark):
    rows = []
    family(random.Random(1), rows, 80, 200, 2)
    df = table(spark, [(d, t, "en", "s") for d, t in rows])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, 3, 85, region=8).collect()}
    assert got == brute_components(rows, 3, 85)


def test_near_duplicates_complete_large_regions(spark):
    # pairs at exactly the threshold: where all regions are large, prefixes of 24 values lose nine of ten
    rows = []
    for pair in range(12):
        for side in range(2):
            words = [*(f"p{pair}x{i}" for i in range(80)), *(f"o{pair}x{side}x{i}" for i in range(10))]
            rows.append((2 * pair + side, " ".join(words), "en", "a"))
    got = neardup.near_duplicates(table(spark, rows), 1, 80, region=1).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 2 for i in range(24)}


@pytest.mark.parametrize("options", [{}, {"region": 8}, {"region": 2}, {"region": 8, "class_shingles": 3000}])
def test_near_duplicates_families_in_any_region(spark, options):
    # variants that are linked to their base alone, at 0.85 to 0.9: most pairs of a region are no links
    rng, rows = random.Random(17), []
    for _ in range(12):
        base = [f"b{rng.random()}" for _ in range(120)]
        rows.append((len(rows), " ".join(base)))
        for _ in range(25):
            words = list(base)
            for at in rng.sample(range(0, 120, 4), 3):
                words[at] = f"v{rng.random()}"
            rows.append((len(rows), " ".join(words)))
    got = neardup.near_duplicates(table(spark, [(d, t, "en", "s") for d, t in rows]), 3, 85, **options).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, 3, 85)


@pytest.mark.parametrize("limit", [neardup.CLASS_SHINGLES, 100])
def test_near_duplicates_of_repeated_and_null_ids(spark, limit):
    rng, rows = random.Random(18), []
    for d in [0, 1, 2, 3, 4, 5, None, None]:  # two texts for each id; every text is linked with the next id's
        rows.append((d, " ".join(rng.choice(WORDS) for _ in range(60))))
    rows += [(None if d is None else (d + 3) % 6, t + " tail") for d, t in rows]
    rows += rows[:3] + [(None, "q w e r t y")] * 50
    numbered = dict(enumerate(rows))
    want = brute_components([(i, t) for i, (_, t) in numbered.items()], 3, 85)
    names = {}
    for i, (d, _) in numbered.items():
        if d is not None:
            names[want[i][1]] = min(d, names.get(want[i][1], d))
    expected = sorted(((d, want[i][0], names.get(want[i][1])) for i, (d, _) in numbered.items()), key=str)
    df = table(spark, [(d, t, "en", "s") for d, t in rows])
    got = neardup.near_duplicates(df, 3, 85, class_shingles=limit).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == expected
    clash = df.withColumnsRenamed({"size": "kept_id", "id": "__id"}).withColumnRenamed("n_chars", "KEPT_HASH")
    kept = neardup.keep_one(clash, 3, 85, class_shingles=limit)
    assert kept.columns == clash.columns and kept.count() == len({root for _, root in want.values()})


def test_near_duplicates_edges(spark):
    rows = [*EDGES, (6, "A b", "en", "a"), (7, "a  B", "en", "a"), (8, "a b c", "en", "a"), (8, "q r s", "en", "a")]
    got = neardup.near_duplicates(table(spark, rows), 3, 85).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["n_shingles"] == 0 and by[1][0]["component_id"] == 1 and by[1][0]["kept"]
    assert by[4][0]["component_id"] == 4 and by[5][0]["n_shingles"] == 1
    assert by[6][0]["component_id"] == by[7][0]["component_id"] == 6 and by[6][0]["kept"] and not by[7][0]["kept"]
    assert neardup.near_duplicates(table(spark, [])).count() == 0
    docs = table(spark, rows[:-1])
    assert neardup.keep_one(docs).columns == docs.columns


# --- 5: quality ----------------------------------------------------------------------------------------------------


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if x in lines[:i] and re.search(r"[^\x20\x09-\x0D]", x))
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_statistics_equal_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["a ", "b ", "c\n", "\n", " ", "# ", "é|", "a b c "]) for _ in range(rng.randint(0, 40)))
        assert quality.text_statistics(text)[:5] == brute_statistics(text), text
    assert quality.text_statistics(None)[:5] == (0, 0, 0, 0, 0)


def quality_tables(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(240):
        good = i % 3 != 0
        text = some_text(rng, 80) if good else " ".join(f"{rng.choice(WORDS).upper()}%%%" for _ in range(80))
        rows.append((i, text, "en", "s"))
        if i % 2:
            labels.append((i, int(good), 0))
    return rows, table(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def test_quality_verdicts(spark):
    rows, docs, labels = quality_tables(spark)
    got = {r["doc_id"]: r for r in quality.quality_verdicts(docs, labels).collect()}
    assert all(not got[i]["kept"] for i in range(0, 240, 3))
    assert sum(got[i]["kept"] for i in range(240) if i % 3) >= 158
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert kept == {i for i in got if got[i]["kept"]}
    edges = {r["doc_id"]: r for r in quality.quality_verdicts(table(spark, EDGES), labels).collect()}
    assert edges[1]["base_failed"] and edges[5]["base_failed"] and edges[5]["n_repeat_words"] == 30000
    assert quality.quality_verdicts(table(spark, []), labels).count() == 0
    alone = quality.quality_verdicts(docs, labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in alone)


def test_isolation_depth():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(500, 3))
    forest = quality.IsolationForest.grow(rows, margin=rows.std(axis=0))
    depth = forest.depths(np.vstack([np.zeros((1, 3)), np.full((1, 3), 8.0)]))
    assert depth[1] < depth[0] - 2
    assert quality.mean_path(256) == pytest.approx(10.24, abs=0.01) and math.isinf(quality.calibrated(depth, np.array([True, True])))


# --- 6: language, 10: toxicity -------------------------------------------------------------------------------------


def learned_tables(spark):
    rng = random.Random(6)
    kinds = {"en": ["the", "and", "ing", "tion"], "fr": ["le", "eau", "oux", "çe"], "de": ["der", "ung", "sch", "ß"]}
    rows, labels = [], []
    for i in range(300):
        lang = rng.choice(list(kinds))
        words = ["".join(rng.choice(kinds[lang]) for _ in range(2)) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(30)] = "horribleword"
        rows.append((i, " ".join(words), lang, "s"))
        labels.append((i, 1, int(bad)))
    return rows, table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_language(spark):
    rows, docs, _ = learned_tables(spark)
    got = {r["doc_id"]: r for r in language.language_of(docs.union(table(spark, EDGES[:1] + [(1000, "12 ?!", None, "s"), (1001, None, "en", "s")]))).collect()}
    held = [(i, lang) for i, _, lang, _ in rows if got[i]["held_out"] and i != 1]
    assert held and all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, lang in held)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und"
    assert language.language_of(table(spark, [])).count() == 0
    untaught = language.language_of(table(spark, [(1, "abc", None, "s"), (None, "x", "en", "s")])).collect()
    assert {r["lang_pred"] for r in untaught} == {"und"}


def brute_bayes(rows, buckets=language.BUCKETS):
    """Naive Bayes with one n-gram at a time, in plain Python."""
    def grams(text):
        body = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
        padded = f" {body} "
        return [int(language.hashed_ngrams(padded[i : i + n], buckets, (n,))[0]) for n in language.LENGTHS for i in range(len(padded) - n + 1)]

    counts = {}
    for i, text, lang, _ in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            own = counts.setdefault(lang, {})
            for g in grams(text):
                own[g] = own.get(g, 0) + 1
    total = {k: sum(v.values()) + language.SMOOTHING * buckets for k, v in counts.items()}
    out = {}
    for i, text, *_ in rows:
        logs = {k: sum(math.log((v.get(g, 0) + language.SMOOTHING) / total[k]) for g in grams(text)) for k, v in counts.items()}
        best = max(sorted(logs), key=logs.get)
        out[i] = best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())
    return out


@pytest.mark.parametrize("batch", [language.BATCH, 50])
def test_language_equals_brute_force(spark, batch, monkeypatch):
    rows, docs, _ = learned_tables(spark)
    model = language.NaiveBayes.fit(docs.where("crc32(cast(doc_id as string)) % 3 <> 1"), 10**6)
    monkeypatch.setattr(language, "BATCH", batch)  # pieces of a text add up to the whole
    langs, scores = model.predict([r[1] for r in rows])
    want = brute_bayes(rows)
    assert langs == [want[r[0]][0] for r in rows] and scores == pytest.approx([want[r[0]][1] for r in rows], rel=1e-4)


def test_toxicity_counts_and_scores_equal_brute_force(spark, monkeypatch):
    rows, docs, labels = learned_tables(spark)
    train = docs.join(labels.selectExpr("doc_id", "cast(toxic as int) label"), "doc_id").select("text", "label")

    def grams(text):
        padded = f" {re.sub(r'[^a-zA-Zçßéè]+', ' ', text.lower()).strip()} "
        return {int(toxicity.hashed_ngrams(padded[i : i + n], toxicity.BUCKETS, (n,))[0]) for n in toxicity.LENGTHS for i in range(len(padded) - n + 1)}

    counts = {}
    for i, text, *_ in rows:
        for g in grams(text):
            counts.setdefault(g, [0, 0])[i % 4 == 0] += 1
    got = {r["bucket"]: [r["clean"], r["toxic"]] for r in toxicity.document_counts(train).collect()}
    assert got == counts
    n = [225, 75]
    sure = {}
    for g, (b, a) in counts.items():
        if a + b >= toxicity.MIN_DOCS:
            ratio = math.log((a + 1) / (n[1] + 2)) - math.log((b + 1) / (n[0] + 2))
            sure[g] = ratio, abs(ratio) / math.sqrt(1 / (a + 1) - 1 / (n[1] + 2) + 1 / (b + 1) - 1 / (n[0] + 2))
    best = toxicity.surest(toxicity.document_counts(train), n[1], n[0], 50).collect()
    assert [r["sure"] for r in best] == pytest.approx(sorted((s for _, s in sure.values()), reverse=True)[:50])
    assert all(r["ratio"] == pytest.approx(sure[r["bucket"]][0]) for r in best)
    model = toxicity.ToxicityModel.fit(train)
    want = [1 / (1 + math.exp(-model.intercept - sum(float(model.weights[g]) for g in grams(t)))) for _, t, *_ in rows]
    assert [model.score(t) for _, t, *_ in rows] == pytest.approx(want, rel=1e-5)
    monkeypatch.setattr(toxicity, "BATCH", 40)
    assert [model.score(t) for _, t, *_ in rows] == pytest.approx(want, rel=1e-5)


def test_contradictory_labels_and_repeated_ids(spark):
    rows, docs, labels = learned_tables(spark)
    twice = labels.union(spark.createDataFrame([(2, 1, 1), (2, 1, 0), (6, 0, 1), (6, 1, 1)], "doc_id long, quality int, toxic int"))
    more = docs.union(table(spark, [(9, "other text", "en", "s")] * 50 + [(None, "x", "en", "s")] * 3))
    runs = [sorted((r["doc_id"] or -1, r["score"]) for r in toxicity.toxicity_of(more.repartition(n), twice.repartition(n)).collect()) for n in (3, 7)]
    assert [d for d, _ in runs[0]] == [d for d, _ in runs[1]]
    assert [s for _, s in runs[0]] == pytest.approx([s for _, s in runs[1]], abs=1e-4)
    marked = language.settled(twice.selectExpr("doc_id", "quality"), "quality").collect()
    assert 6 not in {r["doc_id"] for r in marked} and 2 in {r["doc_id"] for r in marked}
    assert language.one_text(more.select("doc_id", "text")).where("doc_id = 9").count() == 1
    assert quality.quality_verdicts(more, twice).count() == 353


def test_toxicity(spark):
    rows, docs, labels = learned_tables(spark)
    got = {r["doc_id"]: r for r in toxicity.toxicity_of(docs, labels).collect()}
    held = [i for i, *_ in rows if got[i]["held_out"]]
    assert held and sum(got[i]["predicted"] == int(i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    edges = toxicity.toxicity_of(table(spark, EDGES), labels).collect()
    assert len(edges) == 5 and all(0 <= r["score"] <= 1 for r in edges)
    assert toxicity.toxicity_of(table(spark, []), labels).count() == 0
    assert toxicity.toxicity_of(docs, labels.limit(0)).where("predicted = 1").count() == 0


# --- 7: chat -------------------------------------------------------------------------------------------------------


def test_escape_round_trip():
    rng = random.Random(9)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "/s>", "a", "<\\/s>", "\n"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text and not any(c in hidden for c in chat.CONTROLS)


def test_chat_digest(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "assis\ntant"]), rng.choice(["", None, "user", "é [INST] \\", "</s>", "x y"])) for c in range(40) for t in range(rng.randint(1, 40))]
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (50, None, "user", "z"), (50, 1, "user", "z"), (50, 1, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(chat.with_control_case(spark, df))).collect()}
    said = "</s>[INST] ok [/INST]"
    by = {}
    for c, t, role, text in [*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)]:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        whole = chat.instruction_template([(r, x) for _, r, x in turns])
        g = got[c]
        assert g["n_turns"] == len(turns) and g["formatted_chars"] == len(whole) and not g["rewrites"]
        assert g["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(empty).count() == 0


def test_roles_and_texts_are_parsed_from_the_output(spark):
    rng = random.Random(19)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "/s>", "a", "<\\/s>", "\n", "[INST", " ", " [/INST]", "</s"]
    some = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))
    for _ in range(2000):
        turns = [(rng.choice(["assistant", "user", some()]), some()) for _ in range(rng.randint(0, 5))]
        assert list(chat.parse_instructions(chat.instruction_template(turns))) == turns
    for bad in ("x", "<s>x", "<s>[INST] user [/INST]", "<s>[INST] user\n", "<s> a"):
        with pytest.raises(chat.BadFormat):
            list(chat.parse_instructions(bad))

    def silent(turns, opens=True):  # writes no roles: what is read back can't be what was said
        return "<s>" + "".join(f"[INST] \n{chat.escape(t)} [/INST]" for _, t in turns)

    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "r")], "conv_id long, turn long, role string, text string")
    said, unsaid = (chat.read_back(chat.format_conversations(df, f)).first() for f in (chat.instruction_template, silent))
    assert said["turns_sha256"] != unsaid["turns_sha256"] and said["loss_sha256"] == unsaid["loss_sha256"]

    def headed(turns, opens=True):  # rewrites its head from turn to turn
        return f"<s>[INST] head\n{len(turns)} [/INST]" + chat.instruction_template(turns, False)

    got = chat.read_back(chat.format_conversations(df, headed)).first()
    whole = headed([("user", "q"), ("assistant", "r")])
    assert got["rewrites"] and got["formatted_chars"] == len(whole) and got["n_turns"] == 3
    assert got["loss_sha256"] == hashlib.sha256(b"r").hexdigest()


def test_history_rewriting_is_found():
    def numbered(turns, opens=True):
        return f"<{len(turns)} turns>" + "".join(t for _, t in turns)

    spans = list(chat.rendered_turns([("user", "a"), ("user", "b")], numbered))
    assert [s["rewrites"] for s in spans] == [False, True]
    assert all(s["piece"][s["text_start"] : s["text_end"]] == t for s, t in zip(spans, "ab", strict=True))


def test_long_reach_is_rendered_whole(spark):
    def window(turns, opens=True):
        return "".join(f"{r}:{t};" for r, t in turns[-20:])

    def titled(turns, opens=True):
        return "".join(f"{n}/{turns[0][1]}:{t};" for n, (_, t) in enumerate(turns))

    turns = [("user" if i % 2 else "assistant", f"t{i}") for i in range(40)]
    df = spark.createDataFrame([(7, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    cut = sorted(chat.format_conversations(df, window).collect(), key=lambda r: r["position"])
    assert [r["rewrites"] for r in cut] == [i >= 20 for i in range(40)]
    assert all(r["piece"] == window(turns[: i + 1]) for i, r in enumerate(cut) if i >= 20)
    whole = sorted(chat.format_conversations(df, titled).collect(), key=lambda r: r["position"])
    assert "".join(r["piece"] for r in whole) == titled(turns) and not any(r["rewrites"] for r in whole)
    assert all(r["piece"][r["text_start"] : r["text_end"]] == t for r, (_, t) in zip(whole, turns, strict=True) if r["position"])


# --- 8: personal data ----------------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return [(s, e, kind) for s, _, e, kind in sorted(out)]


def test_base_spans_equal_the_patterns():
    rng = random.Random(10)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "300.1.1.1", ".5", "4111 1111 1111 1111", "4111-1111", "+1 (555) 123-4567", "+", "é", " ", "..", "-", "7", "00", "a@b.c@d.e", "1.2.3.4.5.6.7.8"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert pii.base_spans(text) == brute_spans(text), text
    pii.base_spans("1" * 200_000 + "a" * 200_000 + "@" * 1000)


def test_disclosing_terms(spark):
    rows = [(i, f"alpha{'abcdef'[i]} please write to zorblax at bob@x.org about item number beta{'abcdef'[i]}", "en", "s") for i in range(6)]
    rows += [(10 + i, f"please write about item {i} to us", "en", "s") for i in range(60)]
    rows += [(100 + i, "same passage krumpf at eve@y.org", "en", "s") for i in range(5)]
    docs = table(spark, rows)
    got = {r["doc_id"]: r for r in pii.span_digest(pii.personal_data(docs)).collect()}
    text = rows[0][1]
    s = text.index("zorblax")
    assert f"drop:{s}:{s + 7}" in got[0]["spans"] and "krumpf" in rows[66][1]
    assert got[100]["spans"].count(":") == 2  # copies of one passage reveal nothing
    assert got[0]["base_sha256"] == hashlib.sha256(f"email:{text.index('bob')}:{text.index('bob') + 9}".encode()).hexdigest()
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert "zorblax" not in clean[0] and "[EMAIL]" in clean[0] and clean[10] == rows[6][1]
    joined = pii.documents_with(docs, spark.createDataFrame([("zorblax",), ("item",)], "term string"), "text", most=1)
    listed = pii.documents_with(docs, spark.createDataFrame([("zorblax",), ("item",)], "term string"), "text")
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, listed.collect())) == [("item", 66), ("zorblax", 6)]


def test_disclosing_terms_far_from_the_entity(spark):
    far = [f"Zorblax asked {'abcdef'[i] * 4} what to do with all these many letters, so write to bob@x.org or to zorblax" for i in range(6)]
    only = [f"quimby said {'ghijkl'[i] * 4} that one should for this and other things write to the address ann@z.org" for i in range(6)]
    rows = [(i, t, "en", "s") for i, t in enumerate(far + only)]
    rows += [(100 + i, "what to do with all these many letters, so that one should for this and other things write to the address said asked", "en", "s") for i in range(60)]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(table(spark, rows)).collect()}
    assert not any("zorblax" in clean[i].lower() or "quimby" in clean[i + 6] for i in range(6))
    assert all("letters" in clean[i] and "things" in clean[i + 6] for i in range(6))


def planted_terms(rng):
    """Documents of common words; code names go with an address (6 documents each) or with a domain whose addresses
    are each mentioned once."""
    rows, planted = [], set()
    for i in range(500):
        words = some_text(rng, 40).replace("w", "word").translate({48 + d: "abcdefghij"[d] for d in range(10)}).split()
        if i % 4 == 0:
            g = i // 4 % 20
            address = f"boss{'abcdefghij'[g]}@corp.org" if g < 10 else f"p{i}@firm{'abcdefghij'[g - 10]}.org"
            name = f"Code{'abcdefghijklmnopqrst'[g]}x"
            words.insert(rng.randrange(40), address)
            words.insert(rng.randrange(41), name)
            planted.add((i, name.lower()))
        rows.append((i, " ".join(words), "en", "s"))
    return rows, planted


def brute_disclosing(rows):
    n = len(rows)
    docs = []
    for _, text, *_ in rows:
        spans = brute_spans(text)
        free = [m for m in re.finditer(r"[^\W\d_]{3,}", text) if not any(s < m.end() and m.start() < e for s, e, _ in spans)]
        terms, held = [m[0].lower() for m in free], {}
        for s, e, kind in spans:
            before, after = [m[0].lower() for m in free if m.end() <= s], [m[0].lower() for m in free if m.start() >= e]
            for entity in (f"{kind}:{text[s:e]}", f"{kind}@{text[s:e].split('@')[-1]}"):
                held.setdefault(entity, (*before[-5:], *after[:5]))
        places = {t: tuple(terms[max(0, terms.index(t) - 5) : terms.index(t) + 6]) for t in set(terms)}
        docs.append((text, held, places))
    entities = {e for _, held, _ in docs for e in held}
    often = {e for e in entities if len({t for t, held, _ in docs if e in held}) > 1}
    shared = {}
    for _, held, places in docs:
        for e in often & set(held):
            for t, place in places.items():
                shared.setdefault((e, t), []).append((held[e], place))
    out = {}
    for (e, t), seen in shared.items():
        both, witnesses = len(seen), max(len({c for c, _ in seen}), len({c for _, c in seen}))
        with_t, with_e = sum(t in p for *_, p in docs), min(n - 1, sum(e in h for _, h, _ in docs))
        q, p = both / with_t, with_e / n
        disclosure = math.log(q / p) / math.log(1 / p)
        if witnesses >= 2 and disclosure >= pii.GENERALISE:
            apart = (1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0
            if witnesses / q * (q * math.log(q / p) + apart) >= math.log(len(shared) / pii.CHANCE):
                out[e, t] = disclosure
    return out


def test_disclosure_equals_brute_force_and_finds_planted_terms(spark):
    rows, planted = planted_terms(random.Random(31))
    docs = table(spark, rows)
    texts = pii.different_texts(pii.found_in(docs, "doc_id", "text"))
    got = {(r["entity"], r["term"]): r["disclosure"] for r in pii.disclosing(docs, texts, pii.held_entities(texts)).collect()}
    want = brute_disclosing(rows)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    marked = set()
    for r in pii.personal_data(docs).where("added IS NOT NULL").collect():
        marked |= {(r["doc_id"], rows[r["doc_id"]][1][a["start"] : a["end"]].lower()) for a in r["added"]}
    assert marked == planted  # every planted term, and nothing else


def test_wider_class_names_what_a_term_reveals():
    assert pii.replaced("ask Zorb now", [(4, 8, "ip_term")]) == "ask [IP TERM] now"
    assert pii.group_of("email", "a@B.org") == "b.org" and pii.group_of("ip", "1.2.3.4") == "1.2"


def test_counts_of_terms_are_alike_at_every_size(spark):
    docs = table(spark, [(1, "Ⅷabc İstanbul aªb x²y", "en", "s"), (2, "istanbul ⅷABC AªB", "en", "s"), (3, None, "en", "s")])
    terms = spark.createDataFrame([(t.lower(),) for t in {m for x in ("Ⅷabc İstanbul aªb x²y",) for m in pii._TERM.findall(x)}], "term string")
    few, many = (sorted(map(tuple, pii.documents_with(docs, terms, "text", most=m).collect())) for m in (100, 1))
    assert few == many and few


def test_personal_data_edges(spark):
    got = {r["doc_id"]: r for r in pii.span_digest(pii.personal_data(table(spark, EDGES))).collect()}
    assert len(got) == 5 and got[1]["spans"] == "" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.personal_data(table(spark, [])).count() == 0
    clean = pii.sanitised(table(spark, EDGES))
    assert clean.columns == table(spark, []).columns and clean.where("doc_id = 1").first()["text"] is None


# --- 9: licenses ---------------------------------------------------------------------------------------------------


def test_licenses(spark):
    rng = random.Random(12)
    rows = [(i, some_text(rng, 60), "en", "s") for i in range(20)]
    for j, (name, text) in enumerate(licenses.TEMPLATES.items()):
        rows.append((100 + j, f"{some_text(rng, rng.randint(0, 70))}\n{text.upper()} {some_text(rng, 30)}", "en", name))
    got = {}
    for r in licenses.scan_licenses(table(spark, [*rows, *EDGES])).collect():
        got.setdefault(r["doc_id"], {})[r["license_id"]] = r["containment"]
    assert not set(got) & set(range(20)) and not set(got) & {1, 2, 4, 5, None}
    for j, name in enumerate(licenses.TEMPLATES):
        assert got[100 + j][name] == 1.0, name
    assert licenses.scan_licenses(table(spark, [])).count() == 0
    assert all(licenses.miss_bound(len(re.findall("[a-z0-9]+", t.lower()))) < 1e-6 for t in licenses.TEMPLATES.values())


def test_licenses_tell_versions_apart_and_keep_rows_apart(spark):
    gnu = [n for n in licenses.TEMPLATES if "GPL-" in n and n != "GPL-header"]
    rows = [(i, f"x y z {licenses.TEMPLATES[n]} a b c", "en", n) for i, n in enumerate(gnu)]
    rows += [(None, licenses.TEMPLATES["MIT"], "en", "s"), (None, f"one {licenses.TEMPLATES['MIT']}", "en", "s"), (99, licenses.TEMPLATES["GPL-3.0"].replace("3", "4"), "en", "s")]
    rows += [(50, licenses.TEMPLATES["MIT"], "en", "s"), (50, licenses.TEMPLATES["Unlicense"], "en", "s")] * 2
    got = licenses.scan_licenses(table(spark, rows)).collect()
    for i, n in enumerate(gnu):
        assert [r["license_id"] for r in got if r["doc_id"] == i] == [n]
    assert [r["license_id"] for r in got if r["doc_id"] is None] == ["MIT", "MIT"] and not [r for r in got if r["doc_id"] == 99]
    assert sorted(r["license_id"] for r in got if r["doc_id"] == 50) == ["MIT", "Unlicense"]
    with pytest.raises(Exception, match="fewer than three words"):
        licenses.scan_licenses(table(spark, rows), {"short": "two words"}).collect()
