import hashlib
import re
from collections import Counter, defaultdict

import pytest

from feedloom.llm import exact


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode() for _, t in rows]
    groups = defaultdict(list)
    for (i, _), n in zip(rows, norm):
        groups[n].append(i)
    out = []
    for (i, _), n in zip(rows, norm):
        named = [x for x in groups[n] if x is not None]
        out.append((i, min(named, default=None), len(groups[n]), hashlib.sha256(n).hexdigest()))
    return Counter(out), len(groups)


@pytest.mark.parametrize("digest_bytes", [32, 0])
@pytest.mark.parametrize("content", [1 << 26, 100])
def test_equals_brute_force(docs, awkward, monkeypatch, digest_bytes, content):
    """Also with one state key for all texts, so that only their bytes tell them apart."""
    monkeypatch.setattr(exact, "CONTENT_BYTES", content)
    rows = exact.deduplicate(docs, digest_bytes=digest_bytes).collect()
    want, groups = brute(awkward)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows) == want
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == groups == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_empty_table(no_docs):
    assert exact.deduplicate(no_docs).count() == 0


def test_several_micro_batches(docs, awkward, monkeypatch):
    monkeypatch.setattr(exact, "FILES_PER_BATCH", 1)
    rows = exact.deduplicate(docs).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows) == brute(awkward)[0]
