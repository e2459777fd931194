"""The registered queries without SQL, over a whole small table, against brute force."""

import hashlib
import html
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from textmill.llm.language_id import UNKNOWN
from textmill.llm.license_scan import MIN_COVERAGE, REQUIRED, TEMPLATES, Scanner, words_of
from textmill.llm.packing import lower_bound
from textmill.llm.registry import QUERIES

from .test_dedup import components_brute, simhash_brute
from .test_text_models import check_packing, scan_brute

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def rows(spark, name):
    return QUERIES[name](spark, SF_DIR).collect()


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate({k: k + 32 for k in range(65, 91)}))


def test_op2(spark):
    """On the 1,000 documents of the next larger table: some 80 of them are held out."""
    sf_dir = SF_DIR.replace("0.001", "0.01")
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    tokens = {i: [*words(t), None] for i, t in text.items()}
    count = Counter()
    for i, own in tokens.items():
        if remainder(i, 10):
            count.update(own)
    n, v = sum(count.values()), len(count)
    got = QUERIES["op2_lm_score"](spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == set(text)
    for r in got:
        own = tokens[r["doc_id"]]
        base = sum(np.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (remainder(r["doc_id"], 10) == 0, len(own), sum(count[t] > 0 for t in own), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert np.isfinite(r["score"])
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_op3(spark, docs):
    for r in rows(spark, "op3_media"):
        raw = docs[r["doc_id"]]["text"].encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        # The hash by plain means: each cell's mean over samples repeated until cells are whole.
        image = np.frombuffer(payload, dtype=np.uint8).reshape(-1, 64).astype(float)
        cells = image.repeat(8, 0).repeat(9, 1).reshape(8, len(image), 9, 64).mean((1, 3)).round(6)
        assert r["feature"] == np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def test_op4(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    got = rows(spark, "op4_html_extract")
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


def test_op5(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = rows(spark, "op5_sentencepiece")
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r["doc_id"]]["text"])
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want


def test_op6(spark, docs):
    got = rows(spark, "op6_language_id")
    assert {r["doc_id"]: r["held_out"] for r in got} == {i: remainder(i, 4) == 2 for i in docs}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all((r["lang_pred"] == UNKNOWN) == (not any(c.isalpha() for c in docs[r["doc_id"]]["text"])) for r in got)
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in got if r["held_out"]]) > 0.95


def test_op7(spark, docs):
    got = rows(spark, "op7_packing")
    order = sorted(docs)
    place = {i: k for k, i in enumerate(order)}
    n = check_packing([r.asDict() | {"doc_id": place[r["doc_id"]]} for r in got], [docs[i]["text"] for i in order], 1024)
    lengths = np.array([r["length"] for r in got])
    assert all(0 < r["partition_bound"] <= r["partition_sequences"] for r in got)
    # One partition packs this table, so its certificate is that of all.
    (own,) = {(r["partition_sequences"], r["partition_bound"]) for r in got if r["length"] < 1024}
    assert own == (n - (lengths == 1024).sum(), lower_bound(lengths[lengths < 1024], 1024))
    assert n <= (lengths == 1024).sum() + 1.02 * lower_bound(lengths[lengths < 1024], 1024) + 1


def test_op8(spark, docs):
    """Against the alignment of every window of every text with each template that shares enough words."""
    got = {}
    for r in rows(spark, "op8_license_scan"):
        got.setdefault(r["doc_id"], []).append((r["license"], r["n_matched"]))
    assert set(got) == set(docs)
    scanner = Scanner(TEMPLATES, MIN_COVERAGE, REQUIRED)
    for i, own in got.items():
        text = words_of(docs[i]["text"])
        held = Counter(text)
        enough = [t for t, (words, need) in enumerate(zip(scanner.words, scanner.need, strict=True)) if sum(min(n, held[w]) for w, n in Counter(words).items()) >= need]
        want = [(scanner.names[t], n) for _, _, n, t in scan_brute(text, scanner, enough)]
        assert sorted(own, key=str) == sorted(want or [(None, None)], key=str)


def test_op9(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op9_simhash")}
    order = sorted(docs)
    fps = [simhash_brute(docs[i]["text"]) for i in order]
    assert [got[i]["fingerprint"] for i in order] == [f"{x:016x}" for x in fps]
    assert [got[i]["component_id"] for i in order] == [order[k] for k in components_brute(fps)]
