"""Chat formatting, archives, packing, the pipeline and the registration."""

from __future__ import annotations

import random
import zlib
from hashlib import sha1, sha256

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm import plain
from truthloom.llm import registry
from truthloom.llm.chat import chat_digest, format_chats, read_chats
from truthloom.llm.packing import WordTokenizer, pack, sum_of_squares
from truthloom.llm.warc import LoserTree, archive_pages, captures, url_key

SMALL = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
TRAPS = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|", "a<", "|im_end|>", "\\", "<|", "$1", "", None, "é\n中", "<" * 5 + "|" * 3]


def chats():
    draw = random.Random(3)
    rows = []
    for conv in range(40):
        roles = ["system"] * draw.randint(0, 1) + ["user", "assistant"] * draw.randint(1, 3)
        if conv % 5 == 0:
            draw.shuffle(roles)
        rows += [(conv, i, role, draw.choice(TRAPS), "x") for i, role in enumerate(roles)]
    rows += [(50, 0, "user", "same", "x"), (50, 0, "user", "same", "x"), (51, None, None, None, "x"), (None, 0, "tool\n%0A<", "t", "x")]
    return rows


def test_chats_round_trip(spark):
    rows = chats()
    frame = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, segments string").repartition(3)
    held = {}
    for conv, turn, role, text, _ in rows:
        held.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    read = {r.conv_id: r for r in read_chats(format_chats(frame)).collect()}
    told = {r.conv_id: r for r in chat_digest(frame).collect()}
    assert read.keys() == told.keys() == held.keys()
    for conv, turns in held.items():
        turns.sort()
        assert [(t.role, t.text) for t in read[conv].turns] == [(r, t) for _, r, t in turns]
        learnt = "".join(t for _, r, t in turns if r == "assistant")
        assert "".join(s.text for s in read[conv].segments) == read[conv].formatted
        assert read[conv].formatted.count("<|im_end|>") == len(turns)
        assert told[conv].loss_sha256 == sha256(learnt.encode()).hexdigest() and told[conv].loss_chars == len(learnt)
        assert told[conv].turns_sha256 == sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert told[conv].formatted_chars == len(read[conv].formatted) and told[conv].n_turns == len(turns)
        moves = {"": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}
        before, bad = "", None
        for i, (_, role, _) in enumerate(turns):
            if bad is None and role not in moves.get(before, ()):
                bad = i
            before = role
        assert told[conv].first_bad_turn == bad
    assert chat_digest(frame.limit(0)).count() == 0


def test_chats_use_no_python(spark):
    plan = registry.op2_chat(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExistingRDD"))


def test_loser_tree():
    draw = random.Random(2)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((draw.randrange(20), i) for _ in range(draw.randrange(9))) for i in range(k)]
        assert list(LoserTree(runs, lambda row: row)) == sorted(x for run in runs for x in run)


def test_archives_round_trip(spark):
    big, other = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 60, "b" * 1000
    html = [big, "small", big, None, "", other, "small", other, "x" * 999, "x" * 999, "\r\n\r\n" * 300, big]
    rows = [(i, f"http://www.h{i % 3}.example.org:80{i % 2}/p{i % 4}?q={i}", h, "u") for i, h in enumerate(html)]
    rows += [(5, "http://twice.org/", other, "u"), (7, "http://twice.org/", other, "u"), (20, None, "no url", "u"), (21, "a\r\nb", "line", "u"), (None, "http://x.org", big, "u")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(4)
    found = archive_pages(pages).collect()
    assert len(found) == len(rows)
    largest = {}
    for page, _, text, _ in rows:
        if page is not None and len((text or "").encode()) >= 1000:
            largest[text] = max(largest.get(text, -1), page)
    want = []
    for page, _, text, _ in rows:
        raw = (text or "").encode()
        keeper = largest.get(text) if len(raw) >= 1000 else None
        refers = keeper if keeper is not None and keeper != page and (text, page) else None
        want.append((page, len(raw), sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    key = lambda r: (r[0] is None, r[0] or 0, str(r))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=key) == sorted(want, key=key)
    order = [(r.url_key, r.capture_time, r.page_id is not None, r.page_id or 0) for r in found]
    assert order == sorted(order)
    assert archive_pages(pages.limit(0)).count() == 0


def test_url_keys_and_damage():
    assert url_key("http://www.A.example.com:81/x?y=1#f") == "com,example,a:81)/x?y=1" and url_key(None) == ""
    import gzip
    with pytest.raises(ValueError):
        captures("f", gzip.compress(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort\r\n\r\n"))


def test_tokens_are_those_of_whole_texts():
    from tokenizers import Tokenizer
    draw = random.Random(7)
    parts = ["a", "ﬁ", "é", "́", " ", " ", "<|endoftext|>", "'s", "'LL", "ΑΣ", "İ", "12", "!!", "\n", "\x0b", "中文", "👍🏽", "ß", "\x85", "_",
             "e.", "É,", "Ab", "...", "á.", "×", "ÿ", ".", "\x00", "ſ", "Word", "other,"]
    texts = [t or "" for t in plain.edge_texts()] + ["".join(draw.choice(parts) for _ in range(draw.randint(0, 25))) for _ in range(3000)]
    own, whole = WordTokenizer(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    for _ in range(2):  # the second time from memory
        ids, begins = own.ids(pa.array(texts))
        for i, found in enumerate(whole.encode_batch(texts, add_special_tokens=False)):
            assert ids[begins[i] : begins[i + 1]].tolist() == found.ids


def packed_well(rows, texts, capacity=2048):
    from tokenizers import Tokenizer
    whole, seen, bins = Tokenizer.from_file(TOKENIZER), {}, {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, text in texts:
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want = [(p, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for p, s in enumerate(range(0, len(ids), capacity))]
        copies = len(seen[doc]) // len(want)
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in seen[doc]) == sorted(want * copies)
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r.length for r in rows)


def test_packing(spark):
    texts = plain.edge_texts() + plain.random_texts(count=60)
    rows = pack(plain.frame(spark, texts), TOKENIZER).collect()
    held = [(i, t) for i, t in enumerate(texts)] + [(None, "a row without an id that nothing else says at all")]
    bins, total = packed_well(rows, held)
    assert bins <= -(-total // 2048) + 1
    assert pack(spark.createDataFrame([], plain.COLUMNS), TOKENIZER).count() == 0


def test_few_sequences(spark):
    rows = pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), TOKENIZER, share=300).collect()
    assert len({r.sequence_id for r in rows}) <= 1.02 * -(-sum(r.length for r in rows) // 2048)


def test_sum_of_squares_takes_the_least_sum():
    draw = np.random.default_rng(1)
    sizes = np.sort(draw.integers(1, 31, 200))[::-1]
    bins, offsets = sum_of_squares(sizes, 30)
    gaps: dict[int, int] = {}
    for size, bin_, offset in zip(sizes.tolist(), bins.tolist(), offsets.tolist()):
        def after(chosen, size=size):
            left = [g - size * (b == chosen) for b, g in gaps.items()]
            return sum(left.count(g) ** 2 for g in set(left) if 0 < g < 30)
        fitting = [b for b, g in gaps.items() if g >= size]
        if fitting:
            assert bin_ in fitting and after(bin_) == min(map(after, fitting))
        else:
            assert bin_ not in gaps
            gaps[bin_] = 30
        assert offset == 30 - gaps[bin_]
        gaps[bin_] -= size


def test_check_sql_agrees(spark):
    con = duckdb.connect()
    for name in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, SMALL)
        cursor = con.execute(sql)
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(map(str, df.select(columns).collect())) == sorted(map(str, spark.createDataFrame(cursor.fetchall(), df.select(columns).schema).collect())), name


def test_pipeline_against_its_parts(spark):
    """Each stage on its own input, held against brute force where the decision is a rule."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        before, after = {r.doc_id: r.text for r in docs.collect()}, None
        if place < 4:
            assert out.columns == docs.columns, name
            after = {r.doc_id: r.text for r in out.collect()}
        if name == "near_duplicates":
            found = plain.components(list(before.items()))
            assert after.keys() == {i for i, (_, c) in found.items() if c == i}
        elif name == "decontamination":
            assert after.keys() == {i for i, t in before.items() if max(plain.leaks(t, x) for x in items) < 0.75 or not plain.words(t)}
        elif name == "secrets":
            assert after.keys() == before.keys()
            assert {i for i in after if after[i] != before[i]} >= {i for i, t in before.items() if plain.secrets(t)}
        elif name == "packing":
            packed_well(out.collect(), list(before.items()))
        else:
            assert after.keys() <= before.keys() and len(after) > 0.8 * len(before)
        docs = out.cache() if place < 4 else docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
