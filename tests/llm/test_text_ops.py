import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
from starlode.llm import byte_bpe, fingerprints, jaccard_join, licenses, packing, substring_dedup, textvec, token_store, tokens, toxicity
from starlode.llm.common import Scratch, components


def test_pieces_are_those_of_the_patterns():
    rng = random.Random(1)
    letters = [*"abst'' \n\t 12,.!é日x'relvdm ́\x1c\x85", "'s", "'re", "'ll", " '"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for leading, pattern in ((True, P.PATTERN), (False, r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")):
        array, first, keep = textvec.pieces(texts, leading)
        got = array.to_pylist()
        for i, t in enumerate(texts):
            mine = [x for x, k in zip(got[first[i] : first[i + 1]], keep[first[i] : first[i + 1]]) if leading or k]
            assert mine == regex.findall(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"), t)


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_piecewise_encoding_equals_the_library(name, kind):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    letters = "abSTÉé́Σσİ ß1²½<|endoftext|>'sre ll\n\t\x1c\x85 　日本ǅ."
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["<|endoftext|> hi", "don't ''s  x's\n\n  y "]
    library = Tokenizer.from_file(P.path(name))
    library.encode_special_tokens = True
    ids, first = tokens.PieceEncoder(P.path(name), kind).encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert library.encode(t, add_special_tokens=False).ids == ids[first[i] : first[i + 1]].tolist()


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_added_tokens_get_the_ids_of_the_library_at_its_defaults(name, kind):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", " ", "\n\n ", "'s", "abc", " É́", "Σ", "12", "<|"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(2000)] + ["<|endoftext|>", "a <|endoftext|> b", "", "none"]
    library = Tokenizer.from_file(P.path(name))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    ids, first = tokens.encoder(P.path(name), kind).encode(pa.array([*texts, None]))
    assert [ids[first[i] : first[i + 1]].tolist() for i in range(len(texts) + 1)] == [*want, []]


def brute_components(docs, k, num, den):
    sets, up = {}, {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        up[d] = d

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


@pytest.mark.parametrize("block,k,num", [(1024, 3, 90), (4, 3, 90), (3, 5, 80)])
def test_jaccard_join_equals_brute_force(spark, words, block, k, num):
    rng = random.Random(block)
    base, docs = [words(n) for n in (12, 40, 90, 5, 3, 2)], []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice("xyz") * 3
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.join(spark, df, jaccard_join.Settings(k=k, num=num, block=block)).collect()}
    assert got == brute_components(docs, k, num, 100)


def test_jaccard_join_on_odd_rows(spark, odd_docs, no_docs):
    got = jaccard_join.join(spark, odd_docs).collect()
    assert len(got) == 13 and jaccard_join.join(spark, no_docs).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_shingles"] == 0 and by[1]["component_id"] == 1 and by[6]["component_id"] == 5 and by[8]["component_id"] == 7 and by[None]["component_id"] is None


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r[0]: r[1] for r in components(spark, df, Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {200 + i: 100 for i in range(50)}


def test_substring_dedup_finds_planted_passages(spark, words, odd_docs, no_docs):
    passage, rows = words(60), []
    for i in range(30):
        t = words(200)
        if i in (5, 9, 25):
            t[50:50] = passage
        if i == 20:
            q = list(passage)
            for j in (10, 25, 40):
                q[j] = "xx"
            del q[33]
            t[100:100] = q
        if i == 28:
            t[0:0] = passage[:30]
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.passages(spark, df)
    got = {r["doc_id"]: (r["start"], r["stop"], r["a_doc"]) for r in found.collect()}
    assert got == {9: (50, 110, 5), 20: (100, 159, 5), 25: (50, 110, 5)}
    left = {r[0]: r[1] for r in substring_dedup.without(df, found).collect()}
    assert len(left) == 30 and all(len(left[i].split()) == 200 for i in (9, 20, 25)) and left[5] == rows[5][1] and " ".join(passage) not in left[9]
    assert {r["doc_id"] for r in substring_dedup.passages(spark, odd_docs).collect()} == {8}
    assert substring_dedup.passages(spark, no_docs).count() == 0


def test_substring_dedup_finds_edited_passages(spark):
    # A change in every fifth or tenth word, so that no five words or few stay together; strangers around.
    rows, want = [], set()
    for i in range(60):
        step, n = (5, 60) if i % 2 else (10, 80)
        passage = [f"p{i}x{j}" for j in range(n)]
        edited = [f"e{i}x{j}" if j % step == step // 2 else w for j, w in enumerate(passage)]
        for d, part in ((i, passage), (100 + i, edited)):
            rows.append((d, " ".join([*(f"l{d}x{j}" for j in range(70)), *part, *(f"r{d}x{j}" for j in range(70))])))
        want.add((100 + i, i))
    found = substring_dedup.passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["a_doc"]) for r in found} == want
    assert all(r["similarity"] >= 0.8 and r["start"] >= 70 and r["stop"] <= 150 for r in found)


def test_chains_are_the_best_ones():
    s = substring_dedup.Settings()
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 12)
        pairs = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(n)})
        b, a = [p[0] for p in pairs], [p[1] for p in pairs]
        best = [0.0] * len(b)
        for i in range(len(b)):
            best[i] = s.weight + max([0.0] + [best[j] - s.gap_cost * (b[i] - b[j] + a[i] - a[j]) for j in range(i) if b[j] < b[i] and a[j] < a[i]])
        path = substring_dedup.chain(b, a, substring_dedup.Settings(max_gap=1000))[0]
        score = s.weight * len(path) - s.gap_cost * (b[path[-1]] - b[path[0]] + a[path[-1]] - a[path[0]])
        assert abs(score - max(best)) < 1e-9


def test_packing_is_exact_and_tight(spark, words, odd_docs, no_docs):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    rows = [(i, " ".join(words(rng.choice([3, 30, 300, 2500])))) for i in range(60)] + [(100, None), (101, "")]
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(spark, df, P.path("byte_bpe_50k.json"), packing.Settings(share=20, fan_in=2)).collect()
    want = set()
    for d, t in rows:
        ids = np.array(library.encode(t or "").ids + [0], "<u4")
        at = 0
        for p in range(-(-len(ids) // 2048)):
            n = (len(ids) % 2048 or 2048) if not p else 2048
            want.add((d, p, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            at += n
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    bins: dict = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert all(o == sum(n for _, n in b[:i]) for i, (o, _) in enumerate(b)) and sum(n for _, n in b) <= 2048
    assert len(bins) <= 1.1 * -(-sum(r["length"] for r in got) // 2048) + 1
    assert packing.pack(spark, odd_docs, P.path("byte_bpe_50k.json")).select("doc_id").count() >= 13
    assert packing.pack(spark, no_docs, P.path("byte_bpe_50k.json")).count() == 0
    seqs = packing.sequences(spark, df, P.path("byte_bpe_50k.json"))
    assert sum(len(r["ids"]) // 4 for r in seqs.collect()) == sum(r["length"] for r in got)


def test_token_store_round_trip(spark, words, odd_docs, no_docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    shared = words(900)
    rows = [(i * 3, " ".join(shared if i % 3 else words(700))) for i in range(12)] + [(50, None), (51, "")]
    scratch = Scratch(spark, "store")
    path = scratch.path("a")
    token_store.write(spark, spark.createDataFrame(rows, "doc_id long, text string"), path, P.path("word_bpe_49k.json"))
    at = 0
    got = {r["doc_id"]: r for r in token_store.read_digests(spark, path).collect()}
    whole = {r["doc_id"]: r["ids"] for r in token_store.read_ids(spark, path).collect()}
    for d, t in sorted(rows):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and whole[d] == ids
        at += len(ids)
    assert token_store.verify(spark, path) == at
    assert spark.read.parquet(f"{path}/chunks").select("hash").distinct().count() == spark.read.parquet(f"{path}/chunks").count()
    bad = spark.read.parquet(f"{path}/chunks").selectExpr("hash", "concat(data, X'0000') AS data")
    bad.write.parquet(f"{path}/damaged")
    spark.read.parquet(f"{path}/damaged").write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="damaged"):
        token_store.read_digests(spark, path).count()
    for name, df, n in (("b", odd_docs, 13), ("c", no_docs, 0)):
        token_store.write(spark, df, scratch.path(name), P.path("word_bpe_49k.json"))
        assert token_store.read_digests(spark, scratch.path(name)).count() == n


def test_byte_bpe_equals_the_library(spark, words, odd_docs, no_docs):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = byte_bpe.encoding(path, P.PATTERN)
    rows = [(i, " ".join(words(50)) + " naïve 日本\n\n x's 12") for i in range(30)] + [(90, None), (91, "")]
    encoded = byte_bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), path, P.PATTERN)
    got, back = {r[0]: r for r in byte_bpe.digests(encoded, path).collect()}, {r[0]: bytes(r[1]) for r in byte_bpe.decode(encoded, path).collect()}
    for d, t in rows:
        ids = library.encode_ordinary(t or "")
        assert got[d]["n_tokens"] == len(ids) and got[d]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and back[d] == (t or "").encode()
    assert byte_bpe.encode(odd_docs, path, P.PATTERN).count() == 13 and byte_bpe.encode(no_docs, path, P.PATTERN).count() == 0


def test_fingerprints_tell_edits_from_strangers(spark, words, odd_docs, no_docs):
    rows = sorted([(i, " ".join(words(300))) for i in range(40)] + [(100, None), (101, "short"), (103, "short")])
    got = {r["doc_id"]: r for r in fingerprints.compare_edited(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (d, t) in enumerate(rows):
        t, following = t or "", rows[(i + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if len(t) > 100:
            assert got[d]["near_edited"] > 0.5 and got[d]["near_next"] < 0.2
    assert got[101]["fingerprint"] == got[103]["fingerprint"]
    assert fingerprints.compare_edited(spark, odd_docs).count() == 13 and fingerprints.compare_edited(spark, no_docs).count() == 0
    assert fingerprints.fingerprints(odd_docs).count() == 13


def test_toxicity_learns_and_holds_out(spark, words, odd_docs, no_docs):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(600):
        w, toxic = words(60), rng.random() < 0.3
        if toxic:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["grubble", "snark", "vilebit"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.model_for(df, lab)
    assert len(model.index) < 20_000
    truth = dict(labels)
    held = [(r["score"] >= 0.5, truth[r["doc_id"]]) for r in toxicity.score(df, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(p == bool(t) for p, t in held) / len(held) > 0.95
    odd = toxicity.score(odd_docs, model)
    assert odd.columns.count("score") == 1 and all(0 <= r["score"] <= 1 for r in odd.collect()) and toxicity.score(no_docs, model).count() == 0
    assert toxicity.model_for(no_docs, lab).bias == 0.0


def test_licence_rules(spark, odd_docs, no_docs):
    for texts in licenses.SENTENCES.values():
        assert all(re.search(f"(?i){licenses.SIGNS}", t) for t in texts)
    grant = licenses.SENTENCES["mit-grant"][0].replace(", ", ",\n * ")
    mit = f"/*\n * {grant}:\n *\n * The above copyright notice and this permission notice shall be included in all\n * copies or substantial portions of the Software."
    got = licenses.scan(f"x\n{mit}\nHello there. Licensed under CC BY-NC 4.0.\nReleased under the mit licence")
    assert [g[0] for g in got] == ["MIT", "CC-BY-NC-4.0", "MIT"] and got[0][3] == ["mit-grant", "mit-condition"]
    assert licenses.scan("The licence of poets is licensed under nothing.") == [] and licenses.scan("") == []
    df = spark.createDataFrame([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (2, None)], "doc_id long, text string")
    assert [tuple(r)[:4] for r in licenses.scan_documents(df).collect()] == [(1, "MIT", 0, 31)] * 2
    assert licenses.scan_documents(odd_docs).count() == 0 and licenses.scan_documents(no_docs).count() == 0
