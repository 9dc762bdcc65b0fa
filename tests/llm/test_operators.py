"""The corpus operators against brute force, on the small tables and on rows made to be awkward."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from newsdesk.llm import chat_format, decontaminate, embedding_dedup, license_scan, packing, quality, secret_scan, simhash, substring_dedup, tokens, toxicity
from newsdesk.llm.common import alnum_words, space_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{k % 997}" for k in range(60_000))
PASSAGE = " ".join(f"shared{k}" for k in range(70))

#: Nulls, empty, blank and very long texts, repeated rows, ties, and odd characters.
AWKWARD = [
    (1, "One two three. ONE two three!"), (1, "One two three. ONE two three!"), (2, None), (3, ""), (4, " \t\n"), (5, LONG), (6, LONG + " tail"), (None, "no id here at all"), (None, None),
    (7, PASSAGE + " unique seven"), (8, "lead in " + PASSAGE), (9, "x " + PASSAGE + " y " + PASSAGE), (10, "Ünïcode İstanbul K 日本語 😀 under the MIT License, apache-license VERSION 2"), (11, "a\x00b\x1fc"),
    (12, "CC BY NC; cc by-nc <|endoftext|> </s> don't we'll 3.14"), (13, "one TWO three. one two three!"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "en", "src0", 7, 0.5, 1, "x") for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, bucket string").repartition(3)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def empty(documents):
    return documents.limit(0)


#: Names that the operators use for columns of their own.
CLASHING = "score fp bucket chunk hash doc n least copies key node component component_id tile side segment slot ids terms n_tokens start length spans items sequence_id label w pos path before after candidate".split()


def both(documents, awkward):
    """Real and awkward rows with further columns whose names clash."""
    rows = documents.unionByName(awkward.select((F.col("doc_id") + 10_000).alias("doc_id"), "text", "lang", "source", "n_chars"))
    return rows.withColumns({c: F.lit(c) for c in CLASHING})


def test_words_match_their_definitions():
    for _, t in AWKWARD:
        t = t or ""
        assert [w.decode() for w in alnum_words(t.encode())] == WORD.findall(t.translate(ASCII_LOWER))
        assert [w.decode() for w in space_words(t.encode())] == SPACED.findall(t)


# --- packing


def check_pieces(pieces, texts, window=2048):
    encode = tokens.tokenizer(PATH)
    want = sorted((-1 if i is None else i, tuple([*encode.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in texts)
    whole = {}
    for r in pieces:
        whole.setdefault((r.doc_id, r.sequence_id, r.offset), r)
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(bytes(r.ids)) == r.ids_crc32
    assert len(whole) == len(pieces)
    sequences = {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append(r)
    for rows in sequences.values():
        rows.sort(key=lambda r: r.offset)
        at = 0
        for r in rows:
            assert r.offset == at
            at += r.length
        assert at <= window and at & (at - 1) == 0
    by_id = {}
    for r in pieces:
        by_id.setdefault(-1 if r.doc_id is None else r.doc_id, []).append(r)
    total = {}
    for i, ids in want:
        total.setdefault(i, []).append(ids)
    assert set(total) == set(by_id)
    for i, lists in total.items():
        assert sum(r.length for r in by_id[i]) == sum(map(len, lists))
        if len(lists) == 1:
            rows = sorted(by_id[i], key=lambda r: r.start)
            assert tuple(np.concatenate([np.frombuffer(r.ids, "<u4") for r in rows]).tolist()) == lists[0]
            assert [r.start for r in rows] == np.cumsum([0, *[r.length for r in rows]])[:-1].tolist()
            assert all(r.doc_tokens == len(lists[0]) for r in rows)


@pytest.mark.parametrize("shard_bytes", [packing.SHARD_BYTES, 40_000])
def test_packing(documents, awkward, shard_bytes):
    docs = both(documents, awkward)
    check_pieces(packing.pack(docs, PATH, shard_bytes=shard_bytes).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_packing_retrieves_neighbours():
    rng = np.random.default_rng(1)
    topics = [rng.integers(100 * t, 100 * t + 60, (40, 150)).astype(np.uint32) for t in range(1, 5)]
    lists = [topics[k % 4][k // 4] for k in range(160)]
    pieces = packing.pack_shard(lists, np.ones(1000), 150.0, 2048)
    own = [(p[0] % 4) == (p[5] % 4) for p in pieces]
    assert np.mean(own) > 0.9


def test_neighbours_are_all_that_score_best_first():
    rng = np.random.default_rng(4)
    lists = [rng.integers(0, 300, rng.integers(1, 30)).astype(np.uint32) for _ in range(200)] + [np.full(3, 7, np.uint32)] * 40
    idf = np.linspace(0.1, 3, 300)
    shard = packing.Shard(lists, idf, 15.0)
    shard.used[rng.integers(0, 240, 60)] = True
    k1, b = packing.K1, packing.B
    weight = lambda d, t: idf[t] * (tf := (lists[d] == t).sum()) * (k1 + 1) / (tf + k1 * (1 - b + b * len(lists[d]) / 15.0))
    for seed in (0, 5, 77, 210):
        terms = sorted(set(lists[seed].tolist()), key=lambda t: (-weight(seed, t), t))[:12]
        score = {d: sum(weight(d, t) for t in terms if t in lists[d]) for d in range(240) if not shard.used[d]}
        want = sorted((d for d in score if score[d] > 0), key=lambda d: (-round(score[d], 9), d))
        got = list(shard.neighbours(seed))
        assert sorted(got) == sorted(want) and [round(score[d], 9) for d in got] == [round(score[d], 9) for d in want]
    # Forty documents of one term tie: they come in order.
    got = list(shard.neighbours(210))
    tied = [d for d in got if d >= 200]
    assert tied == sorted(tied)


def test_packing_of_nothing(empty):
    assert packing.pack(empty, PATH).count() == 0


def test_encoder_refuses_tokenizers_that_split_otherwise():
    with pytest.raises(ValueError, match="doesn't split"):
        tokens.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_forgets_and_agrees():
    encoder = tokens.WordEncoder(PATH, keep=3)
    texts = [t for _, t in AWKWARD] * 2 + ["  lead  trail ", "a<|startoftext|>b\x1cc x\u2019s K \"'s"]
    for part in ([t] for t in texts), [texts], [texts[:3], texts[3:]]:
        got = []
        for p in part:
            ids, sizes = encoder(pa.array(p, pa.string()))
            got += np.split(ids, np.cumsum(sizes)[:-1])
        assert [g.tolist() for g in got] == [e.ids for e in tokens.tokenizer(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoder_keeps_what_comes_again():
    # Once more is known than may be kept, rare words go; those of every batch aren't encoded again.
    encoder, seen, encoded = tokens.WordEncoder(PATH, keep=1000), [], tokens.WordEncoder._encoded
    encoder._encoded = lambda fresh: seen.extend(fresh) or encoded(encoder, fresh)
    word = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(4))
    common = [f"common{word(k)}" for k in range(200)]
    for k in range(10):
        text = " ".join(common + [f"rare{word(300 * k + j)}" for j in range(300)])
        ids, sizes = encoder(pa.array([text]))
        assert ids.tolist() == tokens.tokenizer(PATH).encode(text, add_special_tokens=False).ids and sizes.tolist() == [len(ids)]
        assert max(len(encoder.words.keys), len(encoder.pieces.keys)) <= 1000 + 500
    assert len(seen) == len(set(seen)) == 200 + 10 * 300
    encoder.words.MOST_BYTES = encoder.pieces.MOST_BYTES = 10
    assert encoder(pa.array([text]))[0].tolist() == ids.tolist()


def test_shards_neighbours_are_the_same_by_either_sum():
    rng = np.random.default_rng(5)
    lists = [rng.integers(0, 3000, rng.integers(1, 60)).astype(np.uint32) for _ in range(400)]
    idf = np.log1p(rng.random(3000) * 50)
    shard, n = packing.Shard(lists, idf, 30.0), 400
    shard.used[::7] = True
    by_position = [list(shard.neighbours(d)) for d in range(n)]
    shard.n = 1 << 40
    assert [list(shard.neighbours(d)) for d in range(n)] == by_position and any(by_position)


# --- decontamination


def brute_contamination(texts, items, window=10):
    spans = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(ASCII_LOWER))
        for k in range(max(1, len(w) - window + 1)) if w else ():
            spans.setdefault(tuple(w[k : k + window]), set()).add(item)
    out = []
    for i, text in texts:
        w = WORD.findall((text or "").translate(ASCII_LOWER))
        hit, found = set(), set()
        for n in {len(s) for s in spans}:
            for k in range(len(w) - n + 1):
                if owners := spans.get(tuple(w[k : k + n])):
                    found |= owners
                    hit |= set(range(k, k + n))
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def test_decontamination(spark, sf, documents, awkward):
    docs = both(documents, awkward)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()
    items = [(r.item_id, r.text) for r in bench] + [(900, "one two"), (901, None), (902, ""), (903, " ".join(f"w{k}" for k in range(5, 40))), (903, "shared3 shared4"), (904, "LICENSE version")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination([(r.doc_id, r.text) for r in docs.collect()], items)
    index = decontaminate.build_index(docs, segment_bytes=200_000)
    for block in (decontaminate.BLOCK_WORDS, 60):
        got = decontaminate.contamination(index, table, block_words=block).drop("spans", "items", "text_hash").collect()
        assert sorted(map(tuple, got), key=str) == want
    kept = decontaminate.uncontaminated(docs, table)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r[5] for r in want)


def test_long_items_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WINDOWS", 7)
    words = [f"v{k}" for k in range(60)]
    docs = [(k, " ".join(words[k : k + 12])) for k in range(48)] + [(50, None), (None, " ".join(words[:9])), (None, " ".join(words))]
    items = [(1, " ".join(words)), (2, " ".join(words[20:29])), (2, " ".join(words[20:29])), (3, " ".join(words[30:40]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(docs, items)
    index = decontaminate.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    for block in (decontaminate.BLOCK_WORDS, 20):
        got = decontaminate.contamination(index, table, block_words=block).drop("spans", "items", "text_hash").collect()
        assert sorted(map(tuple, got), key=str) == want


def test_a_repeated_item_is_collected_once(spark):
    items = spark.range(100_000).select(F.lit(5).cast("long").alias("item_id"), F.lit(" ".join(f"w{k}" for k in range(30))).alias("text"))
    items = items.unionByName(spark.range(20).select((F.col("id") + 10).alias("item_id"), F.concat_ws(" ", *[F.concat(F.lit(f"v{k}x"), "id") for k in range(12)]).alias("text")))
    blocks = decontaminate.phrase_blocks(items, "item_id", "text", 10, 100)
    assert len(blocks) > 1 and sum(b.count() for b in blocks) == 21
    docs = spark.createDataFrame([(1, "start " + " ".join(f"w{k}" for k in range(25)))], "doc_id long, text string")
    got = decontaminate.contamination(decontaminate.build_index(docs), items, block_words=100).first()
    assert (got.n_hit, got.n_items) == (25, 1)


def test_decontamination_of_nothing(spark, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert decontaminate.contamination(decontaminate.build_index(empty), none).count() == 0
    assert decontaminate.contamination(decontaminate.build_index(some), none).first()["n_words"] == 3
    assert decontaminate.uncontaminated(empty, none).count() == 0 and decontaminate.uncontaminated(some, none).count() == 1


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta y gamma"), (2, "alpha x x x x x x x beta gamma"), (3, "beta alpha")], "doc_id long, text string")
    ask = spark.createDataFrame([(7, "alpha beta"), (8, "gamma alpha")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.proximity(decontaminate.build_index(docs), ask, 3).collect()}
    assert got == {(1, 7), (3, 7)}


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WORDS, 9])
def test_proximity_on_a_whole_table(spark, documents, awkward, block):
    docs = both(documents, awkward).coalesce(1)
    words = {i: WORD.findall((t or "").translate(ASCII_LOWER)) for i, t in docs.select("doc_id", "text").collect() if i is not None}
    asked = [(i, w[k + 3] + " " + w[k] + " " + w[k + 9]) for i, w in list(words.items())[::9] if len(w) > 40 for k in (5, 21)] + [(-5, None), (-6, " "), (-7, "shared3 shared9"), (-7, "shared3 shared9"), (None, "the")]
    count = {}
    for w in words.values():
        for x in w:
            count[x] = count.get(x, 0) + 1
    want = set()
    for item, text in asked:
        terms = (text or "").split()
        if item is None or not terms:
            continue
        rarest = min(terms, key=lambda x: count.get(x, 0))
        for i, w in words.items():
            for p in [p for p, x in enumerate(w) if x == rarest]:
                if set(terms) <= set(w[max(0, p - 12) : p + 13]):
                    want.add((i, item, p))
    index = decontaminate.build_index(docs.filter("doc_id is not null"))
    assert index.count() == 1
    got = decontaminate.proximity(index, spark.createDataFrame(asked, "item_id long, text string"), 12, block_words=block).collect()
    assert len(want) > 20 and {tuple(r) for r in got} == want


# --- SimHash


def brute_fingerprint(text):
    w = SPACED.findall((text or "").translate(ASCII_LOWER))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    label = {i: i for i, _ in pairs}
    while True:
        before = dict(label)
        for i, f in pairs:
            for j, g in pairs:
                if (f ^ g).bit_count() <= 2:
                    label[i] = min(label[i], label[j])
        if label == before:
            return label


@pytest.mark.parametrize("tile_rows", [2048, 2])
def test_simhash(documents, awkward, tile_rows):
    docs = both(documents, awkward)
    got = simhash.near_duplicates(docs, tile_rows=tile_rows).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), f"{brute_fingerprint(t):016x}") for i, t in texts)
    label = brute_components(sorted({(i, brute_fingerprint(t)) for i, t in texts if i is not None}))
    assert all(r.component_id == label[r.doc_id] for r in got if r.doc_id is not None)
    kept = simhash.deduplicated(docs, tile_rows=tile_rows)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(label.values()))


def test_simhash_of_nothing(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.deduplicated(empty).count() == 0


def test_tiles_find_every_link_in_a_crowded_block():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, dtype=np.uint64)
    fp = np.unique(np.array([base ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for a, b in rng.integers(0, 64, (300, 2))]))
    i, j = simhash.near(fp, None, 2, block=32)
    want = {(x, y) for x in range(len(fp)) for y in range(x + 1, len(fp)) if int(fp[x] ^ fp[y]).bit_count() <= 2}
    assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == want


# --- licenses


def test_license_scan(spark, documents, awkward):
    docs = both(documents, awkward)
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    want = []
    for r in docs.collect():
        w = WORD.findall((r.text or "").translate(ASCII_LOWER))
        at = [(k, label) for label, p in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want.append((r.doc_id, len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    got = license_scan.scan(docs).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} for r in got)


def test_license_notices_with_changed_words(spark):
    # 29 runs of three; the word put in breaks two of them, the one left out three.
    notice = dict(license_scan.NOTICES)["mit"].split()
    changed = notice[:8] + ["oddly"] + notice[8:12] + notice[13:]
    docs = spark.createDataFrame([(1, " ".join(changed)), (2, " ".join(notice[:6])), (3, "cc by nc cc by nc")], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert got[1].labels == "mit" and got[2].labels == "" and 0 < got[2].score < 0.5
    assert (got[3].n_base, got[3].first_word, got[3].last_word) == (2, 0, 3)
    assert license_scan.scan(docs.limit(0)).count() == 0


# --- chat


def test_chat_format(spark, sf):
    hard = [(-2, 0, "assistant", "<|im_start|>a<\\|im_end|> é😀\n <|endoftext|>"), (-2, 1, "x\n<s>\\n", None), (-2, None, None, "first"), (-2, 1, "assistant", ""), (-3, 5, "assistant", LONG), (None, 0, "user", "lost"), (-4, 0, "assistant", "[INST]<</s>"), (-4, 1, "assistant", " lead")]
    table = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(hard, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat_format.format_conversations(table, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    by = {}
    for r in table.collect():
        if r.conv_id is not None:
            by.setdefault(r.conv_id, []).append(r)
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda r: (r.turn is not None, r.turn or 0, r.role is not None, r.role or "", r.text is not None, r.text or ""))
        pairs = [(r.role or "", r.text or "") for r in turns]
        loss = "".join(t for role, t in pairs if role == "assistant")
        g = got[c]
        assert chat_format.parse(g.formatted) == pairs
        assert (g.n_turns, g.loss_chars, g.formatted_chars) == (len(pairs), len(loss), len(g.formatted))
        assert g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert g.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in pairs).encode()).hexdigest()
        assert len(g.token_ids) == len(g.loss)
    assert chat_format.format_conversations(table.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_texts_that_begin_with_white_space_are_learned_whole(spark):
    texts = ["\n\nfoo", "\n foo", "\n", "\n\n", "\n\n\n", "\nfoo", " \n", "\t\n x\n", "\r\n\r\nfoo", "  foo\n\n", "    ", "\u3000\n\né", ""]
    rows = [(k, turn, role, text) for k, t in enumerate(texts) for turn, (role, text) in enumerate([("user", "\n\nask"), ("assistant", t), ("", "\n"), ("assistant", t + "end" + t)])]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.format_conversations(table, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    for k, t in enumerate(texts):
        assert got[k].loss_sha256 == hashlib.sha256((t + t + "end" + t).encode()).hexdigest(), repr(t)
        assert got[k].loss_chars == 3 * len(t) + 3


def test_escapes_are_reversible():
    for t in (*chat_format.CONTROL, "<\\|im_end|>", "<\\\\|im_end|>", "[\\INST]", "<<s>", "<", "\\", "[[/INST]]"):
        e = chat_format.escape(t)
        assert chat_format.unescape(e) == t and not any(c in e for c in chat_format.CONTROL)


# --- substrings


@pytest.mark.parametrize("size", [{}, {"chunk_bytes": 20_000, "partition_bytes": 50_000}])
def test_substring_dedup(documents, awkward, size):
    docs = both(documents, awkward)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rank = lambda i: 1 << 62 if i is None else i
    first = {}
    words = [(i, SPACED.findall(t or "")) for i, t in texts]
    for i, w in words:
        for k in range(len(w) - 49):
            key = hash(tuple(w[k : k + 50]))
            first[key] = min(first.get(key, rank(i)), rank(i))
    want = []
    for i, w in words:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 49):
            if first[hash(tuple(w[k : k + 50]))] < rank(i):
                gone[k : k + 50] = True
        kept = " ".join(x for x, g in zip(w, gone.tolist(), strict=True) if not g)
        want.append((i, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = substring_dedup.remove_repeats(docs, with_text=True, **size).drop("spans").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(r[2] for r in want) > 140


def test_substring_dedup_tells_every_row_that_shares_an_id(spark):
    shared = " ".join(f"passage{k}" for k in range(55))
    parts = [
        [(9, "a " + shared), (9, "b " + shared + " c"), (None, "d " + shared), (9, "b " + shared + " c")],
        [(None, shared + f" null{k}") for k in range(3)] + [(None, None)],
        [(5, "e f " + shared)], [(None, shared + " g"), (5, shared + " h"), (5, "i " + shared)], [(9, shared), (9, "j " + shared), (7, shared + " k")],
    ]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(parts, len(parts)).flatMap(list), "doc_id long, text string")
    assert docs.rdd.getNumPartitions() == len(parts)
    want = [(i, t if i == 5 else " ".join(w for w in (t or "").split() if not w.startswith("passage"))) for p in parts for i, t in p]
    got = [(r.doc_id, r.kept_text) for r in substring_dedup.remove_repeats(docs, with_text=True).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_substring_dedup_at_both_ends_of_long(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    one, two, three = (" ".join(f"{p}{k}" for k in range(52)) for p in "abc")
    rows = [(high, one), (low, "x " + one), (high, two), (None, two + " y"), (None, three), (None, three + " z"), (low, "only here"), (high, None)]
    want = [(high, ""), (low, "x " + one), (high, two), (None, "y"), (None, three), (None, three + " z"), (low, "only here"), (high, "")]
    for parts in (1, 8):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = [(r.doc_id, r.kept_text) for r in substring_dedup.remove_repeats(docs, with_text=True, chunk_bytes=100).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_substring_dedup_of_a_table_that_is_partitioned_anew_at_each_read(spark):
    shared = " ".join(f"p{k}" for k in range(60))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id", F.lit(" " + shared)).alias("text"))
    shuffled = docs.repartition(7, F.rand())
    got = substring_dedup.remove_repeats(shuffled, with_text=True, chunk_bytes=2_000, partition_bytes=5_000).collect()
    assert sorted((r.doc_id, r.kept_text) for r in got) == [(k, f"t{k} {shared}" if k == 0 else f"t{k}") for k in range(300)]


def test_rows_to_count_grow_with_the_text(spark):
    words = np.random.default_rng(5).integers(0, 1 << 40, (400, 120)).astype(str)
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(words.tolist())], "doc_id long, text string")
    copies = docs.unionByName(docs.selectExpr("doc_id + 1000 as doc_id", "concat(text, ' and more') as text"))
    counts = []
    for n in (200, 400):
        for table in (docs, copies):
            rows, buckets = substring_dedup.dealt(table.filter(f"doc_id % 1000 < {n}"), "doc_id", "text", 4_000, 9_000)
            counts.append([x.count() for x in substring_dedup.windows(rows, buckets, 50)])
    (once, none), (twice, met), (once2, none2), (twice2, met2) = counts
    assert none == none2 == 0 and 200 * 71 / 25 < once < 200 * 71 / 8 and abs(once2 / once - 2) < 0.1
    assert abs(met2 / met - 2) < 0.1 and abs(twice2 / twice - 2) < 0.1 and 200 * 71 < met <= 200 * 144
    # A quarter of all rows being one row makes no chunk larger than an input split.
    same = docs.filter("doc_id < 200").unionByName(spark.range(100).selectExpr("7L as doc_id", f"'{' '.join(words[7])}' as text")).repartition(8)
    rows, _ = substring_dedup.dealt(same, "doc_id", "text", 4_000, 9_000)
    assert rows.groupBy("chunk").count().agg(F.max("count")).first()[0] < 60
    assert substring_dedup.remove_repeats(same).agg(F.sum("n_removed")).first()[0] == 0


def test_anchors_are_smallest_inner_hashes():
    hasher = substring_dedup.Windows(50)
    words = np.random.default_rng(1).integers(0, 1 << 60, 300).astype(np.uint64)
    inner = hasher.within(words)
    assert hasher.anchors(words).tolist() == [inner[k : k + 35].min() for k in range(251)]
    assert len(hasher.anchors(words[:49])) == 0 and len(hasher.anchors(words[:50])) == 1


def test_substring_dedup_of_nothing(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0


# --- secrets


def test_secret_scan(spark):
    key = "0c497b5014f705c0be648d68b816f88c209136eb"
    texts = [(1, f'and the token = "{key}" onntsttion'), (2, f"fixed in commit {key} today"), (3, f'TOKEN = "{key.upper()}"!! and token = "{key[::-1]}"'), (4, None), (5, ""), (6, "plain words only"), (None, f'secret: "{key}"'), (1, f'and the token = "{key}" onntsttion'), (7, "x" * 300_000 + f' token = "{key}"')]
    docs = spark.createDataFrame([(i, t, "src0", len(t or ""), 1, True) for i, t in texts], "doc_id long, text string, source string, n_chars long, score int, is_secret boolean")
    found = secret_scan.scan(docs).collect()
    texts_of = {1: texts[0][1], 2: texts[1][1], 3: texts[2][1], None: texts[6][1], 7: texts[8][1]}
    assert all(texts_of[r.doc_id][r.start : r.start + r.length] == r.candidate for r in found)
    assert sorted((str(r.doc_id), r.is_secret) for r in found) == sorted([("1", True), ("1", True), ("2", False), ("3", True), ("3", True), ("None", True), ("7", True)])
    clean = secret_scan.redacted(docs)
    assert clean.columns == docs.columns and clean.count() == len(texts)
    got = {(r.doc_id, r.text) for r in clean.collect()}
    assert (1, 'and the token = "[SECRET]" onntsttion') in got and (2, texts[1][1]) in got and (3, 'TOKEN = "[SECRET]"!! and token = "[SECRET]"') in got and (4, None) in got and (5, "") in got
    assert all(key not in (t or "") for i, t in got if i != 2)
    assert secret_scan.scan(docs.limit(0)).count() == 0


def test_secrets_without_digits_by_any_name_and_whole_keys(spark):
    plain, mixed, low = "0c497b5014f705c0be648d68b816f88c209136eb", "AbCdEfGhIjKlMnOpQrSt", "qzxkvjwpfmhtbrgdyqkz"
    body = "\n".join(hashlib.sha512(str(k).encode()).hexdigest().upper()[:64] for k in range(5))
    pem = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,00\n\n{body}\n-----END RSA PRIVATE KEY-----"
    bare = f"-----BEGIN EC PRIVATE KEY-----\n{body}"
    held = [
        (f'the token = "{mixed}" here', mixed), (f'the api_key: "{low}" here', low), ('the Password: "hkW!qzRt#vx" here', "hkW!qzRt#vx"), (f'one s3_secret_access_key="{plain}" two', plain), (f"AWS_SECRET_ACCESS_KEY_V2={plain} x", plain),
        (f'{{"auth_token": "{mixed}"}}', mixed), (f"Authorization: Bearer {mixed} x", mixed), (f"one {pem} two", pem), (f"one {bare}", bare), ("k = " + "a" * 300 + plain + " z", None),
    ]
    clean = ["the Internationalisation of getUserAccountName in /Users/Name/Documents", "The key: because nothing else", "Donaudampfschifffahrt und Nationalversammlung", 'class="navigationContainerName"']
    docs = spark.createDataFrame([(k, t, "src0") for k, t in enumerate([t for t, _ in held] + clean)], "doc_id long, text string, source string")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = secret_scan.scan(docs).collect()
    assert all(texts[r.doc_id][r.start : r.start + r.length] == r.candidate for r in found)
    secrets = {}
    for r in found:
        if r.is_secret:
            secrets.setdefault(r.doc_id, []).append(r.candidate)
    for k, (t, secret) in enumerate(held):
        assert secret is None or secrets.get(k) == [secret], (t, secrets.get(k))
    assert any(r.doc_id == len(held) - 1 and r.length > 300 for r in found)
    assert not [r for r in found if r.doc_id >= len(held) and r.is_secret]
    got = {r.doc_id: r.text for r in secret_scan.redacted(docs).collect()}
    assert all(got[k] == (t.replace(secret, "[SECRET]") if secret else got[k]) for k, (t, secret) in enumerate(held))
    for r in secret_scan.candidates(docs).collect():
        assert r.before == texts[r.doc_id][max(0, r.start - secret_scan.BEFORE) : r.start]


def test_candidates_and_redaction_against_brute_force(spark, documents):
    import regex

    many = " ".join(f'token{k} = "{hashlib.sha256(str(k).encode()).hexdigest()}" word' for k in range(3000))
    docs = documents.unionByName(spark.createDataFrame([(50_000, many, "en", "src0", len(many)), (None, many[:900], "en", None, 900), (50_001, "Key: aB1cD2", "en", "x", 11)], documents.schema))
    pattern = regex.compile(secret_scan.CANDIDATE, regex.ASCII)
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = sorted((str(i), m.start(), m[0]) for i, t in texts.items() for m in pattern.finditer(t or ""))
    found = secret_scan.scan(docs).collect()
    assert sorted((str(r.doc_id), r.start, r.candidate) for r in found) == want and len(want) > 3000
    secrets = {}
    for r in found:
        if r.is_secret:
            secrets.setdefault(r.doc_id, []).append((r.start, r.length))
    for r in secret_scan.redacted(docs).collect():
        out, at = "", 0
        for start, n in sorted(secrets.get(r.doc_id, [])):
            out, at = out + texts[r.doc_id][at:start] + "[SECRET]", start + n
        assert r.text == (out + texts[r.doc_id][at:] if texts[r.doc_id] is not None else None)
    assert len(secrets[50_000]) > 2900


def test_one_text_at_several_paths_is_redacted_by_each_paths_verdicts(spark):
    """Two rows of one (null) id and one text that the forest judges by their path; nothing of the one tells of the other."""
    hexes = lambda k: hashlib.sha1(str(k).encode()).hexdigest()
    texts = [f'token = "{hexes(k)}" then commit {hexes(k + 100)} and the client Authorization: Bearer {hexes(k + 200)[:32]}' for k in range(12)]
    rows = [(i, t, p) for t in texts for i, p in ((None, "deploy"), (None, "tests/fixtures"), (None, None), (None, "deploy"), (7, "docs/example"), (7, "deploy"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    verdicts = {}
    for r in secret_scan.scan(docs, with_path=True).collect():
        verdicts.setdefault((r.doc_id, r.text_hash, r.path), {})[r.start] = (r.length, r.is_secret)
    hashed = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    want = []
    for i, t, p in rows:
        out, at = "", 0
        for start, (n, secret) in sorted(verdicts[i, hashed[t], p].items()):
            out, at = out + t[at:start] + ("[SECRET]" if secret else t[start : start + n]), start + n
        want.append((i, out + t[at:], p))
    assert sorted(map(tuple, secret_scan.redacted(docs).collect()), key=str) == sorted(want, key=str)
    by_path = {p: [s for (i, h, q), v in verdicts.items() if q == p for _, s in v.values()] for p in ("deploy", "tests/fixtures")}
    assert by_path["deploy"] != by_path["tests/fixtures"]


def test_forest_learns_from_given_findings(spark):
    """Findings of shapes that the rule-made table doesn't have: here what ends in x is a secret."""
    rng = np.random.default_rng(2)
    value = lambda n: "".join(rng.choice(list("abcdef0123456789"), n))
    rows = [(value(30) + "XYZW" * y, "note: ", " ", "src", float(y)) for _ in range(150) for y in (0, 1)]
    findings = spark.createDataFrame(rows, "candidate string, before string, after string, path string, label double")
    a, b = value(30), value(30)
    docs = spark.createDataFrame([(1, f"note: {a}XYZW and {b} here", None), (2, None, "x"), (3, "", "")], "doc_id long, text string, source string")
    got = {r.candidate: r.is_secret for r in secret_scan.scan(docs, findings).collect()}
    assert got == {f"{a}XYZW": True, b: False}
    assert {r.doc_id: r.text for r in secret_scan.redacted(docs, findings).collect()} == {1: f"note: [SECRET] and {b} here", 2: None, 3: ""}
    assert secret_scan.redacted(docs.limit(0), findings).count() == 0


def test_forest_on_findings_it_did_not_see(spark):
    table = secret_scan.labelled_findings(spark, 150)
    numbered = table.withColumn("h", F.pmod(F.xxhash64("candidate", "before"), F.lit(3)))
    model = secret_scan.train(numbered.filter("h > 0"))
    rows = model.transform(secret_scan.features(numbered.filter("h = 0"))).select("label", "prediction").collect()
    assert np.mean([r.label == r.prediction for r in rows]) > 0.97


# --- quality


def test_quality_on_held_out_labels(spark, documents, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.score(documents, labels, allowed="crc32(cast(doc_id as string)) % 3 <> 1")
    rows = out.join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([r["keep"] == (r.quality == 1) for r in held]) > 0.9
    assert out.count() == documents.count()


def test_quality_of_awkward_rows(spark, awkward, sf, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (5, None), (3, 7)], "doc_id long, quality int")
    rows = quality.score(awkward, labels).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.score(awkward, labels.limit(0)).collect()} == {0.5}
    assert quality.score(empty, labels).count() == 0


def test_quality_against_brute_force(spark, documents, sf):
    """The same co-training over all documents, in one process: the surest rows come from the whole table."""
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()
    docs = documents.collect()
    known = {r.doc_id: float(r.quality) for r in labels if r.quality in (0, 1) and r.doc_id % 3}
    x = {r.doc_id: np.concatenate([quality.text_features(r.text.encode()), quality.meta_features(r.lang, r.source, r.n_chars)]).astype("<f4").astype(float) for r in docs}
    ids = sorted((i for i in x if i in known), key=lambda i: (zlib.crc32(str(i).encode()), i))
    pool = sorted(i for i in x if i not in known and i % 3)
    y, u, n = np.array([known[i] for i in ids]), np.stack([x[i] for i in pool]), quality.TEXT_SIZE

    def surest(models):
        out = []
        for m, v in zip(models, (u[:, :n], u[:, n:]), strict=True):
            p = quality._sigmoid(quality._apply(m, v))
            tops = [(1.0, y.mean(), -p, p >= quality.SURE), (0.0, 1 - y.mean(), p, p <= 1 - quality.SURE)]
            at = [(label, [k for k in np.lexsort((pool, by)).tolist() if sure[k]][: max(1, int(quality.SHARE * share * len(pool)))]) for label, share, by, sure in tops]
            rows = [k for _, chosen in at for k in chosen]
            out.append((u[rows][:, :n], u[rows][:, n:], np.array([label for label, chosen in at for _ in chosen])))
        return out

    labelled = np.stack([x[i] for i in ids])
    model = quality.co_train(labelled[:, :n], labelled[:, n:], y, surest)
    everything = np.stack([x[r.doc_id] for r in docs])
    want = model.views(everything[:, :n], everything[:, n:])[2]
    got = {r.doc_id: r.score for r in quality.score(documents, spark.read.parquet(f"{sf}/labels.parquet"), allowed="doc_id % 3 <> 0").collect()}
    assert [got[r.doc_id] for r in docs] == pytest.approx(want.tolist(), abs=1e-6)


def test_views_exchange_labels():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 60).astype(float)
    u = rng.integers(0, 2, 600).astype(float)
    text = lambda v: np.stack([v + 0.1 * rng.standard_normal(len(v)), np.ones(len(v))], 1)
    meta = lambda v: np.stack([v + 0.8 * rng.standard_normal(len(v)), np.ones(len(v))], 1)
    xt, xm = text(u), meta(u)

    def surest(models):
        out = []
        for m, x in zip(models, (xt, xm), strict=True):
            p = quality._sigmoid(quality._apply(m, x))
            at = np.concatenate([np.argsort(-p)[:20], np.argsort(p)[:20]])
            out.append((xt[at], xm[at], np.repeat([1.0, 0.0], 20)))
        return out

    model = quality.co_train(text(y), meta(y), y, surest)
    _, _, p = model.views(text(u), meta(u))
    assert np.mean((p > 0.5) == (u == 1)) > 0.97


# --- embeddings


@pytest.mark.parametrize("tile_rows", [2048, 8])
def test_embedding_dedup(spark, tile_rows):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    rows = []
    for k in range(200):
        x = base[k % 40] + 0.02 * (k % 5) * rng.standard_normal(16)
        rows.append((k, [float(np.float32(v)) for v in x], k % 40 % 3))
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 1), (302, None, 0), (303, [0.0] * 16, 0), (304, [float("nan")] * 16, 0), (305, rows[1][1], None), (306, [None, *rows[0][1][1:]], 0), (307, [], 0), (308, rows[0][1][:8], 0), (300, rows[0][1], 0), (None, rows[0][1], 0)]
    table = spark.createDataFrame([(*r, "x", 9) for r in rows], "vec_id long, embedding array<float>, label int, key string, component long").repartition(3)
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    links = {id(r): [s for s in ok if s is not r and s[2] == r[2] and len(s[1]) == len(r[1]) and np.dot(r[1], s[1]) / (np.linalg.norm(r[1]) * np.linalg.norm(s[1])) >= 0.98] for r in ok}
    label = {r[0]: r[0] for r in rows}
    for _ in range(20):
        for r in ok:
            for s in links[id(r)]:
                label[r[0]] = min(label[r[0]], label[s[0]])
    got = embedding_dedup.near_duplicates(table, tile_rows=tile_rows).collect()
    want = [(r[0], len(links.get(id(r), ())), None if r[0] is None else label[r[0]]) for r in rows]
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == sorted(want, key=str)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_vectors_of_any_finite_size(spark):
    rows = [(1, [1e200, 0.0]), (2, [1e200, 0.0]), (3, [3e-320, 0.0]), (4, [1e308, 1e307]), (5, [-1e200, 0.0]), (6, [float("inf"), 1.0]), (7, [5e-324, 5e-324]), (8, [1.0, 1.0]), (9, [0.0, -0.0]), (2, [0.0, 7.0])]
    table = spark.createDataFrame([(i, v, "a") for i, v in rows], "vec_id long, embedding array<double>, label string")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(table).collect())
    assert got == [(1, 3, 1), (2, 0, 2), (2, 3, 1), (3, 3, 1), (4, 3, 1), (5, 0, 5), (6, 0, 6), (7, 1, 7), (8, 1, 7), (9, 0, 9)]


def test_large_labels_meet_in_cells(spark):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal((30, 24))
    x = np.concatenate([centre[k % 30] + 0.11 * rng.standard_normal((1, 24)) for k in range(500)])
    table = spark.createDataFrame([(k, v, int(k % 10 == 0)) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.arange(500) % 10 == 0
    links = (u @ u.T >= 0.98) & (label[:, None] == label) & ~np.eye(500, dtype=bool)
    got = embedding_dedup.near_duplicates(table, tile_rows=40).collect()
    assert 0 < links.sum() and [r.n_links for r in sorted(got)] == links.sum(axis=1).tolist()


def test_what_tiles_ship_per_vector(spark):
    """One label of random vectors at two sizes: a vector goes to as many tiles as there are parts to compare with, in 8 bits a component."""
    rng = np.random.default_rng(3)
    seen = []
    for n in (400, 800):
        table = spark.createDataFrame([(k, v, 1) for k, v in enumerate(rng.standard_normal((n, 32)).tolist())], "vec_id long, embedding array<double>, label int")
        _, groups = embedding_dedup.grouped(table, "vec_id", "embedding", "label")
        row = embedding_dedup.dealt(groups, 0.98, 100).agg(F.count("*").alias("n"), F.max(F.length("q")).alias("bytes")).first()
        assert row["bytes"] == 32
        seen.append(row["n"] / n)
    print("tiles a vector goes to:", seen)
    assert seen[1] < 27 + 8


def test_quantisation_bound_holds():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, e = embedding_dedup.quantised(x)
    approx = (q.astype(float) @ q.T.astype(float)) * np.outer(s, s)
    assert (np.abs(approx - x @ x.T) <= e[:, None] + e[None] + np.outer(e, e) + 1e-12).all()


# --- toxicity


INSULTS = ["worthless", "idiot", "disgusting", "pathetic", "scum"]


def toxic_corpus(n=900, seed=4):
    rng = np.random.default_rng(seed)
    plain = ["".join(rng.choice(list("thenrdiosagl"), rng.integers(2, 9))) for _ in range(900)]
    rows, labels = [], []
    for k in range(n):
        words = [plain[j] for j in rng.integers(0, len(plain), 60)]
        bad = k % 6 == 0
        if bad:
            for at in rng.integers(0, 60, 4):
                words[at] = INSULTS[int(rng.integers(len(INSULTS)))]
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    return rows, labels, plain


def test_toxicity(spark):
    rows, labels, plain = toxic_corpus()
    extra = [(10_000, "you w.o.r.t.h.l.e.s.s idxiot and p4thetic sc*um " + " ".join(plain[:40])), (10_001, " ".join(plain[:80])), (10_002, None), (10_003, ""), (None, "idiot scum worthless"), (10_004, "i d i o t w o r t h l e s s and d1sgusting " + " ".join(plain[:20]))]
    docs = spark.createDataFrame([(i, t, "toxic", 1.0) for i, t in rows + extra], "doc_id long, text string, lang string, score double")
    table = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxic(docs, table).collect()}
    assert len(got) == len(rows) + len(extra)
    truth = dict(labels)
    held = [r for r in got.values() if r.held_out and r.doc_id in truth]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values() if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert got[10_000].predicted == 1 and got[10_004].predicted == 1
    assert [got[i].predicted for i in (10_001, 10_002, 10_003)] == [0, 0, 0]
    kept = toxicity.without_toxic(docs, table)
    assert kept.columns == docs.columns and kept.filter("doc_id = 10000").count() == 0 and kept.filter("doc_id = 10001").count() == 1
    assert {r.score for r in toxicity.toxic(docs, table.limit(0)).collect()} == {0.0}
    assert toxicity.toxic(docs.limit(0), table).count() == 0


def test_a_document_is_scored_by_its_sentences():
    names, weights, bias = ["idiot", "scum", "there"], np.array([2.0, 1.5, -0.25]), -0.75
    text = "there idiot idiot\nyou sc*um. i d i o t and more words than one there! 日本。 " + "long " * 90

    def plain(word, name):
        return float(toxicity.Landmarks([name]).kernel([word], 1)[0, 0]) ** 3

    scores = []
    sentences = [["there", "idiot"], ["\0"], ["you", "sc*um."], ["i", "d", "o", "t", "and", "more", "words", "than", "one", "there!"], ["日本。"], ["long"], ["long"], ["long"]]
    for k, sentence in enumerate(sentences):
        words = [*sentence, "idiot"] if k == 3 else sentence
        near = [[max((plain(r, name) for r in toxicity.folded(w.encode())), default=0.0) for name in names] for w in words]
        scores.append(float(np.sum(np.array(near) @ weights)) + bias)
    # The line end belongs to the sentence it ends.
    scores[0] += scores.pop(1) - bias
    x = toxicity.Scorer(toxicity.Model(names, weights, bias, np.zeros(6))).documents([text.encode(), b"", None])
    top = sorted(scores, reverse=True)[:3]
    assert x[0] == pytest.approx([*top, np.log1p(sum(s > 0 for s in scores)), np.log1p(len(scores))], abs=1e-4)
    assert x[1].tolist() == x[2].tolist() == [toxicity.LOW] * 3 + [0, 0]


def test_toxicity_on_held_out_documents(spark):
    """On real labels: of 18 held-out toxic documents, few of them in each language, at least two thirds, and no more than one false alarm."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.toxic(docs, labels).join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").filter("held_out").collect()
    caught, toxic_ones = sum(r.predicted and r.toxic for r in rows), sum(r.toxic for r in rows)
    print(f"caught {caught} of {toxic_ones}, {sum(r.predicted and not r.toxic for r in rows)} false alarms in {len(rows) - toxic_ones}")
    assert caught >= 2 / 3 * toxic_ones and sum(r.predicted and not r.toxic for r in rows) <= 1


def test_kernel_is_the_gapped_subsequence_kernel():
    import itertools

    def plain(word):
        s, out = f"^{word}$", {}
        for i, j, k in itertools.combinations(range(len(s)), 3):
            if k - i <= toxicity.SPAN:
                out[s[i] + s[j] + s[k]] = out.get(s[i] + s[j] + s[k], 0) + toxicity.DECAY ** (k - i - 2)
        return out

    words = ["idiot", "idxiot", "aaaa", "of"]
    k = toxicity.Landmarks(words).kernel(words, 1)
    for a, b in itertools.product(range(len(words)), repeat=2):
        x, y = plain(words[a]), plain(words[b])
        dot = sum(v * y.get(g, 0) for g, v in x.items())
        assert k[a, b] == pytest.approx(dot / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())), abs=1e-5)
    assert k[0, 1] > 0.6 > k[0, 3]
