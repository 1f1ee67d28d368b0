"""The registered queries over the smallest tables against brute force, other libraries, held-out labels and DuckDB."""

from __future__ import annotations

import hashlib
import html
import math
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from orrery.llm import queries, secret_scan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def rows(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "pages", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    flat = lambda found, names: sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found)
    assert flat(df.collect(), df.columns) == flat(want.fetchall(), want.columns)


def test_language_on_held_out_documents(spark, documents):
    lang = {i: x for i, _, x, _ in documents}
    got = rows(spark, "op1_language_id")
    assert len(got) == len(documents)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    tested = [r for r in got if r["held_out"] and lang[r["doc_id"]] is not None]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in tested) >= 0.97 * len(tested)
    assert sum(r["rejected"] for r in got) <= 0.01 * len(got)


def test_secrets(spark, documents):
    # The patterns as they stand in the contract, each match dropped afterwards where it is too short.
    kinds = [
        (re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 12, 1),
        (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18, 0),
        (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16, 0),
    ]
    # Bare credentials, from their definition: long tokens, mixed, of high entropy, that no base span touches.
    def bare_of(text, taken):
        for m in re.finditer(r"[A-Za-z0-9+/_-]+", text):
            v, (a, b) = m[0], m.span()
            mixed = all(len(re.findall(c, v)) >= 3 for c in ("[0-9]", "[A-Z]", "[a-z]"))
            bits = sum(-v.count(c) / len(v) * math.log2(v.count(c) / len(v)) for c in set(v))
            if len(v) >= 24 and mixed and bits >= 4 and all(e <= a or b <= s for s, _, e, _ in taken):
                yield a, 3, b, v

    spans, owner_of, owners = {}, {}, defaultdict(set)
    for _, text, _, source in documents:
        owner_of[text or ""] = min(owner_of.get(text or "", source or ""), source or "")
    for i, text, _, source in documents:
        found = sorted((m.start(), k, m.end(), m[g]) for k, (p, ok, g) in enumerate(kinds) for m in p.finditer(text or "") if ok(m))
        bare = list(bare_of(text or "", found))
        spans[i] = found, sorted(found + bare)
        for *_, v in found + bare:
            owners[v].add(owner_of[text or ""])
    listed = lambda s: ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b, _ in s)
    live = lambda v: len(owners[v]) <= secret_scan.LIVE_OWNERS
    for r in rows(spark, "op2_secret_scan"):
        base, every = spans[r["doc_id"]]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in base) for k in range(3)]
        assert r["base_sha256"] == hashlib.sha256(listed(base).encode()).hexdigest()
        kept = [s for s in every if s[1] < 3 or live(s[3])]
        assert r["spans"] == listed(kept) and r["n_live"] == sum(live(s[3]) for s in kept) and r["n_shared"] == len(kept) - r["n_live"]


def test_packing(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t, *_ in documents}
    pieces, bins, total = defaultdict(list), defaultdict(list), 0
    for r in rows(spark, "op3_best_fit_packing"):
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        total += r["length"]
    assert total == sum(map(len, ids.values()))
    for i, own in pieces.items():
        own.sort()
        assert [p for p, *_ in own] == list(range(len(own))) and [s for _, s, _ in own] == [sum(n for *_, n in own[:k]) for k in range(len(own))]
        assert len(own) == 1 or all(n == 2048 for *_, n in own[1:])
        assert len(own) == -(-len(ids[i]) // 2048)
    for own in bins.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    assert len(bins) <= 1.02 * total / 2048 + 1


def test_codec(spark, documents):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {i: t or "" for i, t, *_ in documents}
    for r in rows(spark, "op4_sentencepiece"):
        ids = np.array(model.encode(text[r["doc_id"]]), "<u4")
        assert (len(ids), zlib.crc32(ids.tobytes())) == (r["n_ids"], r["ids_crc32"])
        assert r["restored"] and r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_near_duplicates(spark, documents):
    sets = {}
    for i, t, *_ in documents:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) or frozenset([tuple(w)] if w else [])
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                label[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows(spark, "op5_near_dedup")}
    assert got == {i: (len(s), top(i), top(i) == i) for i, s in sets.items()}


def test_pages(spark):
    got = {r["page_id"]: r for r in rows(spark, "op9_html_extract")}
    for i, page in duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall():
        body = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.DOTALL)
        cut = re.split(r"</?(?:p|h1)>", body[1].replace("<br>", " ")) if body else []
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", "", b)).split()) for b in cut]
        assert got[i]["text"] == "\n\n".join(b for b in blocks if b) and got[i]["n_chars"] == len(got[i]["text"])
