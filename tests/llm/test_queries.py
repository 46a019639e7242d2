"""The opN_ queries against plain versions of what they return."""

import hashlib
import re
import zlib

import pytest

from staveforge.llm import queries as Q

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_shards(spark, docs):
    got = Q.op2_histogram_sort(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        raw = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_toxicity(spark, docs):
    got = Q.op4_counterfactual_toxicity(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_mix(spark, docs):
    got = Q.op5_entropy_balance(spark, SF).collect()
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for i, d in docs.items()}
    total, target, taken = {}, {}, {}
    for i, d in docs.items():
        total[d.source] = total.get(d.source, 0) + sizes[i]
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode("utf-32-be")) + [s for s in total if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full: set = set()
    while True:
        rest, share = sum(total.values()) - sum(3 * total[s] for s in full), sum(weight[s] for s in names if s not in full)
        target = {s: 3 * total[s] if s in full else rest * weight[s] / share for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * total[s] + 1e-9}
        if not over:
            break
        full |= over
    for r in got:
        s = docs[r.doc_id].source
        assert (r.size, r.source_size) == (sizes[r.doc_id], total[s]) and abs(r.target - target[s]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] = taken.get(s, 0) + r.taken
    for s in names:  # within half of the largest document of the source
        assert abs(taken[s] - target[s]) <= max(sizes[i] for i, d in docs.items() if d.source == s) / 2 + 1
    again = {r.doc_id: r.taken for r in Q.op5_entropy_balance(spark, SF).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_licenses(spark, docs):
    phrases = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
    for r in Q.op9_license_rules(spark, SF).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (docs[r.doc_id].text or "").translate(LOW))
        at = sorted((i, k) for k, p in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({k for _, k in at})) and {k for _, k in at} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_media(spark, docs):
    for r in Q.op10_iso_media(spark, SF).collect():
        raw = (docs[r.doc_id].text or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_bytes > r.payload_bytes and len(r.media_sha256) == 64
