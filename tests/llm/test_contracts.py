"""The operators with contracts against brute force."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from glassine.llm import decontam, langid, simhash, spotsigs, tokenfile, warc
from glassine.llm.shared import connected_components

VOCABULARY = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


# --- WARC -------------------------------------------------------------------------------------------------------------


def sha(html):
    return base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()


def page_rows(found):
    out = {}
    for r in found.collect():
        fields = r["metadata"]["fields"]
        out[int(fields["pageId"]) if "pageId" in fields else None] = (
            r["response"]["type"], r["response"]["size"], r["response"]["digest"], int(fields["refersToPageId"]) if "refersToPageId" in fields else None,
        )
    return out


def test_archives_round_trip(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in warc.query(spark, sf).collect()}
    assert got.keys() == pages.keys()
    for i, html in pages.items():
        assert got[i]["payload_bytes"] == len(html.encode()) and got[i]["payload_digest"] == sha(html)


def test_revisits(spark):
    tricky = "b\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "u", "a"), (9, "u2", "a"), (2, "v", None), (4, None, ""), (None, "x", "a"), (5, "y\r\nz", tricky), (5, "y\r\nz", tricky), (6, "w", "é" * 100_000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    found = warc.transactions(pages)
    ids = [x[k]["id"] for x in found.collect() for k in ("response", "request", "metadata")]
    assert len(ids) == len(set(ids)) == 3 * len(rows)
    assert Counter((r["response"]["type"], r["response"]["size"]) for r in found.collect() if r["metadata"]["fields"].get("pageId") == "5") == {
        ("response", len(tricky)): 1, ("revisit", len(tricky)): 1
    }
    got = page_rows(found.where("response.type = 'response' OR coalesce(metadata.fields['pageId'], '') <> '5'"))
    assert got[1] == ("revisit", 1, sha("a"), 9) and got[9] == ("response", 1, sha("a"), None)
    assert got[None] == ("revisit", 1, sha("a"), 9)
    assert got[2] == ("revisit", 0, sha(""), 4) and got[4][0] == "response"
    assert got[5] == ("response", len(tricky), sha(tricky), None) and got[6][1] == 200_000
    assert page_rows(warc.transactions(pages, least_bytes=2))[1][0] == "response"
    assert warc.transactions(pages.limit(0)).count() == 0


def test_whole_table_of_archives(spark, sf):
    """Every page's record by brute force, with repeated rows and payloads too large to share a file."""
    some = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    rows = [tuple(r) for r in some.collect()]
    rows += rows[:3] + [(900 + i, "big", str(i % 2) * (200_000 + 100_000 * (i // 2))) for i in range(6)] + [rows[0]]
    pages = spark.createDataFrame(rows, some.schema)
    top = {}
    for i, _, html in rows:
        top[html or ""] = max(i, top.get(html or "", i))
    seen, want = set(), []
    for i, _, html in sorted(rows, key=lambda r: -r[0]):
        html = html or ""
        kind = "revisit" if html in seen else "response"
        seen.add(html)
        want.append((i, len(html.encode()), sha(html), kind, top[html] if kind == "revisit" else None))
    path = warc.scratch_path(spark, "warc")
    warc.write_archives(pages, path)
    found = warc.assemble(warc.read_records(spark, path))
    fields = [F.col("metadata.fields")["pageId"].cast("long"), "response.size", "response.digest", "response.type", F.col("metadata.fields")["refersToPageId"].cast("long")]
    assert sorted(map(tuple, found.select(*fields).collect()), key=repr) == sorted(want, key=repr)


def test_transactions_link_both_ways(spark):
    rec = lambda kind, id, to=None: (kind, id, to, None, "u", "d", 1, {})
    rows = [rec("response", "r1", "q1"), rec("request", "q1"), rec("metadata", "m1", "q1"), rec("response", "r2"), rec("request", "q2", "r2"), rec("request", "q2", "r2"), rec("request", "lost", "zz")]
    records = spark.createDataFrame(rows, warc.RECORD + ", fields map<string,string>")
    got = {r["capture_id"]: (r["request"] and r["request"]["id"], r["metadata"] and r["metadata"]["id"]) for r in warc.assemble(records).collect()}
    assert got == {"r1": ("q1", "m1"), "r2": ("q2", None)}


# --- language ID ------------------------------------------------------------------------------------------------------


def test_languages_held_out(spark, sf, docs):
    got = {r["doc_id"]: r for r in langid.query(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    tried = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r["held_out"]} == {r["doc_id"] for r in tried}
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in tried) >= 0.95 * len(tried)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_edges(spark, odd, docs):
    model = langid.train(docs)
    got = {r["doc"]["doc_id"]: r["lang_pred"] for r in langid.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == got[6] == "und"
    assert got[5] == "en" and got[8] in model.langs and got[4] in model.langs
    empty = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(odd, empty).collect()} == {"und"}
    assert langid.predict(odd.limit(0), model).count() == 0


def test_more_languages_than_a_word_has_bits(spark):
    words = {f"l{i:03}": " ".join("".join(chr(97 + (i * 7 + j * k) % 26) for k in range(3, 11)) + chr(0x4E00 + i) * 5 for j in range(6)) for i in range(70)}
    df = spark.createDataFrame([(text, lang) for lang, text in words.items() for _ in range(3)], "text string, lang string")
    model = langid.train(df)
    assert len(model.langs) == 70
    got = {(r["doc"]["lang"], r["lang_pred"]) for r in langid.predict(df, model).collect()}
    assert got == {(lang, lang) for lang in words}


def test_a_rare_language_keeps_what_it_shares(spark):
    rng = np.random.default_rng(1)
    shared = ["alba", "costa", "fiume", "monte"]
    own = {"big": ["zwkrp", "qvxtz"], "rare": ["hjyfl", "bnmgd"]}
    text = lambda lang: " ".join(rng.choice(shared + own[lang], 60).tolist())
    rows = [(i, text("big"), "big") for i in range(600)] + [(1000 + i, text("rare"), "rare") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    bit = model.langs.index("rare")
    h, _ = langid._grams(["alba costa fiume monte"])
    mask = model.table[h & np.uint64((1 << langid.SLOT_BITS) - 1)][:, 0]
    assert ((mask >> np.uint64(bit)) & np.uint64(1)).mean() > 0.7
    got = Counter((r["doc"]["lang"], r["lang_pred"]) for r in langid.predict(df, model).collect())
    assert got[("rare", "rare")] == 12 and got[("big", "big")] == 600


def test_prediction_depends_on_the_text_alone(spark):
    texts = ["  the cat ", "x. ", " the cat", "", None, "le chat  et", " le chat et la souris"]
    df = spark.createDataFrame(
        [(i, t, "en" if i < 4 else "fr", {"k": i}) for i, t in enumerate(texts * 3)], "doc_id long, text string, lang string, `a.b` map<string,int>"
    )
    model = langid.train(df)
    one = {r["doc"]["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df.coalesce(1), model).collect()}
    for n in (2, 7):
        again = {r["doc"]["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df.orderBy(F.desc("doc_id")).repartition(n), model).collect()}
        assert again == one
    assert [len(langid._grams(["x. " * k, " the cat"])[0][langid._grams(["x. " * k, " the cat"])[1] == 1]) for k in (0, 1)] == [5, 5]


def test_filters_have_no_false_negatives(docs):
    model = langid.train(docs.where("lang = 'en'"))
    probe = np.uint64((1 << langid.SLOT_BITS) - 1)
    text = docs.where("lang = 'en'").first()["text"]
    h, _ = langid._grams([text * 2])
    counts = Counter(h.tolist())
    seen = np.array([g for g, n in counts.items() if n >= 4], np.uint64)
    mask = model.table[seen & probe]
    for k in range(1, langid.PROBES):
        mask &= model.table[(seen >> np.uint64(langid.SLOT_BITS * k)) & probe]
    assert (mask == 1).all()


def test_long_texts_come_in_pieces(monkeypatch):
    monkeypatch.setattr(langid, "CHUNK", 50)
    text = "the quick brown fox jumps over the lazy dog " * 20
    whole, _ = langid._grams([text])
    parts = np.concatenate([langid._grams(group)[0] for _, group in langid._pieces([text])])
    assert abs(len(parts) - len(whole)) <= 2 * len(text) // 50 and set(parts.tolist()) >= set(whole.tolist())


# --- SimHash ----------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closed(ids, prints, bits):
    label = {i: i for i in ids}

    def find(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {i: find(i) for i in ids}


def test_simhash_is_exact(spark, sf, texts):
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.query(spark, sf).collect()}
    assert {i: f for i, (f, _) in got.items()} == prints
    assert {i: c for i, (_, c) in got.items()} == closed(list(texts), prints, 3)


def test_simhash_edges(odd):
    got = simhash.simhash_components(odd).collect()
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: (r["fp"], r["component_id"]) for r in got}
    assert by_id[1] == by_id[2] == by_id[6] == (0, 1)
    assert by_id[5][1] == 5 and by_id[None][1] is None
    assert simhash.simhash_components(odd.limit(0)).count() == 0


@pytest.mark.parametrize("crowded", [2048, 4])
def test_dense_fingerprints(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    prints = {int(c) for c in centres}
    for c in centres:
        for _ in range(60):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= 1 << int(b)
            prints.add(x)
    ids = sorted(prints)
    fps = spark.createDataFrame([(simhash._signed(x),) for x in ids], "fp long")
    edges = simhash.links(fps)
    pairs = edges.collect()
    assert all(((r["a"] ^ r["b"]) & simhash.ONES).bit_count() <= 3 for r in pairs)
    signed = {simhash._signed(x): x for x in ids}
    found = fps.withColumn("doc_id", F.col("fp"))
    got = {signed[r["doc_id"]]: signed[r["component_id"]] for r in simhash.components(found, edges).collect()}
    want = closed(sorted(ids, key=simhash._signed), {x: x for x in ids}, 3)
    assert len(set(got.values())) == len(set(want.values()))
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups(got) == groups(want)


def test_near_duplicates_of_the_stage(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, n = [], 0
    for g in range(30):
        base = rng.choice(vocabulary, 300).tolist()
        rows.append((n, g, " ".join(base)))
        n += 1
        for _ in range(2):
            copy = list(base)
            for at in rng.integers(0, 300, 4):
                copy[at] = "changed"
            rows.append((n, g, " ".join(copy)))
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, g long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    first = {g: min(i for i, h, _ in rows if h == g) for _, g, _ in rows}
    caught = sum(got[i] == first[g] for i, g, _ in rows)
    assert caught >= 0.97 * len(rows)
    group = {i: g for i, g, _ in rows}
    assert all(group[i] == group[c] for i, c in got.items())


def test_star_of_copies(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 5000, 300)]
    texts = [" ".join(base)]
    for i in range(200):
        copy = list(base)
        for at in rng.choice(np.arange(5, 295, 10), 6, replace=False):
            copy[at] = f"x{i}"
        texts.append(" ".join(copy))
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    alike = [len(sets[0] & s) / len(sets[0] | s) for s in sets]
    assert min(alike) >= 0.8
    # The original has the largest id, so that a walk starts at a copy.
    df = spark.createDataFrame([(len(texts) - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = Counter(r["component_id"] for r in simhash.near_duplicates(df).collect())
    assert got.most_common(1)[0][1] >= 0.97 * len(texts)


def test_near_duplicates_count_whole_sets(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for g in range(40):
        base = [f"g{g}w{i}" for i in range(1000)]
        copy = list(base)
        n = 21 if g % 2 else 23  # Jaccard 0.809 and 0.793, far within the sketch's error
        for at in 10 + 20 * rng.permutation(48)[:n]:
            copy[at] = "changed"
        a, b = (set(zip(*(t[k:] for k in range(5)))) for t in (base, copy))
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
        want[g] = len(a & b) / len(a | b) >= 0.8
    # One repeated shingle decides both fingerprints of these, which share little else.
    filler = "a b c " * 400
    rows += [(1000, filler + " ".join(f"p{i}" for i in range(200))), (1001, filler + " ".join(f"q{i}" for i in range(200)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert got[1000] == 1000 and got[1001] == 1001
    linked = {g: got[2 * g + 1] == 2 * g for g in want}
    assert not any(linked[g] for g in want if not want[g])
    assert sum(linked[g] for g in want if want[g]) >= 0.95 * sum(want.values())


def test_tiles_and_rounds_agree(spark, monkeypatch):
    """Groups none of whose members is close to all others, with and without rounds, in one tile and in many."""
    rng = np.random.default_rng(8)
    members, sets = [], []
    for g in range(6):
        common = rng.integers(0, 1 << 60, 200)
        for i in range(40):
            # Neighbours in the row are alike, others aren't.
            own = [(g << 32) + (i * 12 + k) % 480 for k in range(60)]
            node = g * 1000 + i
            sets.append((node, sorted([*common[:60].tolist(), *own])))
            members += [(g, node, 120), (g + 100, node, 120)]
    sets = spark.createDataFrame(sets, "node long, shingles array<long>")
    members = spark.createDataFrame(members, "key long, node long, size long")
    got = set()
    for rounds, tile in ((0, 256), (0, 8), (3, 8), (3, 256)):
        monkeypatch.setattr(simhash, "ROUNDS", rounds)
        monkeypatch.setattr(simhash, "TILE", tile)
        edges = simhash._joined(members, sets, 0.8)
        roots = {r["node"]: r["root"] for r in connected_components(edges).collect()}
        got.add(tuple(sorted(roots.items())))
    assert len(got) == 1 and set(roots.values()) == {g * 1000 for g in range(6)} and len(roots) == 240


def test_recall_by_band(spark):
    """Pairs in bands of exact Jaccard from 0.80 up."""
    rng = np.random.default_rng(12)
    rows, alike = [], {}
    for g in range(600):
        words = [f"g{g}w{i}" for i in range(int(rng.integers(60, 400)))]
        copy = list(words)
        places = rng.choice(np.arange(5, len(words) - 5, 10), max(1, int(len(words) * (0.004 + 0.024 * g / 600))))
        for at in set(places.tolist()):
            copy[at] = "changed"
        a, b = (set(zip(*(t[k:] for k in range(5)))) for t in (words, copy))
        alike[g] = len(a & b) / len(a | b)
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(copy))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert all(got[2 * g + 1] == 2 * g + 1 for g in alike if alike[g] < 0.8)
    for low in (0.80, 0.84, 0.88, 0.92):
        band = [g for g in alike if low <= alike[g] < low + 0.04]
        assert len(band) >= 20 and sum(got[2 * g + 1] == 2 * g for g in band) >= 0.97 * len(band), low


# --- SpotSigs ---------------------------------------------------------------------------------------------------------


def test_edited_texts(spark, sf, texts):
    got = {r["doc_id"]: r for r in spotsigs.query(spark, sf).collect()}
    ids = sorted(texts)
    for i, j in zip(ids, ids[1:] + ids[:1]):
        t, n = texts[i], texts[j]
        changed = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        own, new, its = (Counter(spotsigs.signatures(x).tolist()) for x in (t, changed, n))
        for other, value in ((new, r["near_edited"]), (its, r["near_next"])):
            whole = sum((own | other).values())
            want = sum((own & other).values()) / whole if whole else 1.0
            assert value == pytest.approx(want if want >= spotsigs.LEAST else 0.0)
    prints = {texts[i]: got[i]["fingerprint"] for i in ids}
    assert all(prints[texts[i]] == got[i]["fingerprint"] for i in ids)


def test_pruned_likeness(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(spotsigs, "STEP", 7)
    for _ in range(300):
        a, b = (np.sort(rng.integers(0, rng.integers(2, 60), rng.integers(0, 80)).astype(np.uint32)) for _ in range(2))
        x, y = Counter(a.tolist()), Counter(b.tolist())
        want = sum((x & y).values()) / max(1, sum((x | y).values())) if x or y else 1.0
        for least in (0.0, 0.3, 0.8):
            assert spotsigs.likeness(a, b, least) == pytest.approx(want if want >= least else 0.0)


def test_spotsig_edges(odd):
    got = spotsigs.compare_with_next(odd).collect()
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["n_chars"] == by_id[2]["n_chars"] == 0 and by_id[1]["near_next"] == 1.0
    assert [r["near_next"] for r in got if r["doc_id"] == 5].count(1.0) == 1
    assert spotsigs.compare_with_next(odd.limit(0)).count() == 0
    one = spotsigs.compare_with_next(odd.where("doc_id = 8")).first()
    assert one["near_next"] == 1.0


def test_spotsig_pairs(docs, texts):
    members, links = spotsigs.near_pairs(docs)
    sets = {}
    for i, t in texts.items():
        sets.setdefault(tuple(spotsigs.signatures(t).tolist()), []).append(i)
    assert {r["doc_id"]: r["class_id"] for r in members.collect()} == {i: min(ids) for ids in sets.values() for i in ids}
    want = set()
    keys = [k for k in sets if k]
    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            u, v = Counter(a), Counter(b)
            if sum((u & v).values()) / sum((u | v).values()) >= 0.8:
                want.add(tuple(sorted((min(sets[a]), min(sets[b])))))
    assert {(r["a"], r["b"]) for r in links.collect()} == want


# --- decontamination --------------------------------------------------------------------------------------------------


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, named = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            n = min(window, len(v))
            for i in range(len(v) - n + 1) if n else ():
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == v[i : i + n]:
                        hit |= set(range(at, at + n))
                        named.add(str(item_id))
        ids = ",".join(sorted(named))
        out.append((doc_id, len(w), len(hit), len(named), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination_cases(spark):
    a = "one two three four five six seven eight nine ten eleven twelve"
    items = [(1, a), (2, "Short Item"), (3, None), (4, ""), (10, "the the the the the the the the the the the"), (5, "absent words only here " * 5), (2, "Short Item")]
    docs = [
        (1, f"Before, {a}! after"), (2, "one two three four five six seven eight nine TEN"), (3, "one two three four five six seven eight nine eleven"),
        (4, "a short item, short ITEM short"), (5, " ".join(["the"] * 25)), (6, None), (7, ""), (8, "çÉ " + a.upper() + " short item"), (8, "çÉ " + a.upper() + " short item"),
        (None, a), (9, " ".join(a.split()[2:]) + " " + a),
    ]
    left = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, term string, pos int")
    right = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, p string")
    got = sorted(map(tuple, decontam.decontaminate(left, right).collect()), key=repr)
    assert got == brute_hits(docs, items)
    assert decontam.decontaminate(left.limit(0), right).count() == 0
    clean = decontam.decontaminate(left, right.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r["contaminated"] for r in clean)


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    texts = ["alpha beta gamma delta", "alpha x beta gamma delta", "beta alpha gamma delta", "alpha beta gamma", "alpha x y z beta gamma delta"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    item = decontam.item_words(items)
    index = decontam.build_index(docs, item.select("term"))
    ids = {r["row"]: r["doc_id"] for r in index.docs.collect()}
    near = lambda slop: {ids[r["row"]] for r in decontam.proximity_matches(index, item, slop).collect()}
    assert near(0) == {0} and near(1) == {0, 1, 2} and near(3) == {0, 1, 2, 4}


# --- token files ------------------------------------------------------------------------------------------------------


def test_token_files(spark, sf, texts, library):
    got = sorted(tokenfile.query(spark, sf).collect(), key=lambda r: r["doc_id"])
    start = 0
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [0]
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_file_format(spark, odd, tmp_path):
    from pyarrow import orc

    path = f"file://{tmp_path}/tokens"
    tokenfile.write_tokens(odd.repartition(3), path)
    rows = tokenfile.read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8]
    assert rows[1]["n_tokens"] == rows[2]["n_tokens"] == 1 and rows[1]["ids"] == [0]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))
    files = sorted((tmp_path / "tokens").glob("*.orc"))
    assert sum(orc.ORCFile(str(f)).nrows for f in files) == odd.count()
    assert tokenfile.token_files(odd.limit(0)).count() == 0
    one = spark.read.orc(path).where("doc_id = 4")
    assert one.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,4)]" in one._jdf.queryExecution().toString()


def test_encoder_equals_the_library(library):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from glassine.llm.tokenizer import encoder

    mine = encoder(VOCABULARY)
    alphabet = st.sampled_from([*" \n\tab'sdtrelAZé1٣ß漢.,!?-_", "🙂", " ", "　", "\x1c", "\x85", "'re", "<|endoftext|>", "  ", " \n \n", " word", " word,", "word", "\n", "\n\n", "###", "_", ".\nWord"])

    @settings(max_examples=1500, deadline=None)
    @given(st.lists(alphabet, max_size=14).map("".join))
    def check(text):
        # Twice: what is kept must be the same.
        ids, at = mine.encode(pa.array([text, None, "", text], pa.string()))
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want + want and np.diff(at).tolist() == [len(want), 0, 0, len(want)]

    check()


def test_encoder_in_many_chunks(library, monkeypatch, docs):
    from glassine.llm import tokenizer

    monkeypatch.setattr(tokenizer, "CHUNK_BYTES", 5000)
    monkeypatch.setattr(tokenizer, "WORDS", 300)
    import public_tokenizers

    mine = tokenizer.Encoder(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    texts = [r["text"] for r in docs.limit(150).collect()]
    ids, at = mine.encode(pa.array(texts, pa.string()))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == want
    assert mine.encode(pa.array([], pa.string()))[0].tolist() == []
