"""Decontamination, packing, archives and the pipeline."""

import zlib

import numpy as np
import pytest
from postlens.llm import decontaminate, packing, warc
from postlens.llm.queries import tokenizer
from postlens.session import staging_root

import corpus_pipeline

QUESTION = "A farmer named Anna sold 12 kg of fresh apples to her neighbour Boris yesterday " \
    "and then Anna bought 30 more red boxes for the garden"


def found(spark, *texts, item=QUESTION):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, None), (None, item), (9, "short one")],
                                  "item_id long, text string")
    rows = decontaminate.contamination(docs, items).collect()
    assert {r.item_id for r in rows} <= {7}
    return {r.doc_id for r in rows}


def test_templates(spark):
    again = QUESTION.replace("Anna", "Clara").replace("Boris", "Diego").replace("12 kg", "7 pounds") \
        .replace("30", "1,250.5")
    mixed = again.replace("Clara bought", "Diego bought")
    short = " ".join(QUESTION.split()[8:16])
    assert found(spark, QUESTION, f"Before. {QUESTION}. After", again, "unrelated words only",
                 QUESTION.upper(), None, "", short) == {0, 1, 2, 4}
    rows = found(spark, mixed)
    assert rows == set() or rows == {0}
    whole = decontaminate.Benchmark([1], [QUESTION], decontaminate.WIDTH)
    assert max(h[3] for h in whole.hits([again])[0]) == len(QUESTION.split())
    assert not [h for h in whole.hits([mixed])[0] if h[3] == len(QUESTION.split())]


def test_slots_must_agree():
    known = decontaminate.Benchmark([1], [QUESTION], 22)
    good = QUESTION.replace("Anna", "Clara")
    assert known.hits([good])[0]
    assert not known.hits([good.replace("Clara bought", "Eva bought")])[0]
    assert not known.hits([QUESTION.replace("Boris", "Anna")])[0]


def test_consistent_parts_of_a_run(spark):
    again = QUESTION.replace("Anna", "Clara").replace("Boris", "Diego")
    # One name differs the second time; an excerpt ends before a number, another one follows.
    mixed = again.replace("Clara bought", "Diego bought")
    excerpt = " ".join(QUESTION.split()[5:19]) + " 12 grey bags of flour"
    sums = "Then 12 men with 30 carts came to the old mill and 12 of them left again"
    assert found(spark, mixed, excerpt) == {0, 1}
    assert found(spark, sums.replace("30", "12"), item=sums) == {0}
    assert found(spark, sums.replace("30", "7").replace("12 of", "9 of"), item=sums) == {0}
    known = decontaminate.Benchmark([7], [QUESTION], decontaminate.WIDTH)
    ends = [(len(mixed.encode()[:b].split()), len(mixed.encode()[:e].split()))
            for _, b, e, _ in known.hits([mixed], parts=True)[0]]
    assert sorted(ends) == [(0, 17), (14, 26)]


def test_parts_against_all_cuts():
    r = np.random.default_rng(7)
    words = QUESTION.lower().split()
    for _ in range(200):
        at = np.sort(r.choice(np.arange(1, 26), 8, replace=False))
        ours, theirs = list(words), list(words)
        for i in at:
            ours[i], theirs[i] = (f"{'VWX'[v]}{'ab'[v % 2]}o" for v in r.integers(0, 3, 2))
        known = decontaminate.Benchmark([1], [" ".join(ours)], 10)
        x = decontaminate.Tokens([" ".join(theirs)])

        def agree(b, e):
            pairs = {(ours[i], theirs[i]) for i in at if b <= i < e}
            return len({p for p, _ in pairs}) == len(pairs) == len({q for _, q in pairs})

        good = [(b, e) for b in range(26) for e in range(b + 10, 27) if agree(b, e)]
        want = [(b, e) for b, e in good
                if not any(c <= b and e <= f and (b, e) != (c, f) for c, f in good)]
        assert known.consistent(x, 0, 0, 26) == sorted(want)


def test_plain_words_are_needed(spark):
    item = "The and 1 2 3 4 5 6 7 8 9 10 11 12 13 14"
    assert found(spark, "The and 5 6 7 8 9 10 11 12 13 14 15 16 17 18", item=item) == set()


def test_openers_and_longer_names(spark):
    item = "Tom has 5 apples. Sue has 7 pears. Ann has 9 plums. Who has the most?"
    again = item.replace("Tom", "Bob").replace("Sue", "Eve").replace("Ann", "Mary Kim")
    assert found(spark, item, again.replace("7", "12"), again.replace("Who has", "Who had"),
                 item=item) == {0, 1}
    item = "After the game Anna owed Boris 5 coins while Boris owed Clara 9 coins and Clara owed Anna 3"
    again = item.replace("Boris", "Leo").replace("Clara", "Eva Lund").replace("Anna", "Mary Ann")
    assert found(spark, again, again.replace("while Leo", "while Mary Ann"), item=item) == {0}
    assert found(spark, item, item=again) == {0}
    assert decontaminate.Units(decontaminate.Tokens(["So Anna Smith, Bo met Al. Tom O'Neil"])).first \
        .tolist() == [0, 3, 4, 5, 6]
    whole = decontaminate.Benchmark([1], [QUESTION], 10).hits([QUESTION, ""], parts=True)
    assert whole == [[(1, 0, len(QUESTION), 26)], []]


def test_items_without_a_rich_window(spark):
    items = ["What is the capital of France?", "2 + 3 * 4 = ?", "1 2 3 4 5 6 7 8 9 10 11 12 13", "Yes",
             "法国的首都是哪里？请写出它的名字和人口", "東京は？", "ฝรั่งเศสมีเมืองหลวงชื่อว่าอะไร", "?!"]
    copies = [f"Before this. {i} And after." for i in items[:4]] + \
        [f"它说：{i}谢谢" for i in items[4:7]]
    others = ["What is the capital of Spain?", "2 - 3 * 4 =", "1 2 3 4 5 6 7 8 9 10 11 12 14", "yesterday",
              "法国很美", "東京", "1 2 3 4 5 6 7 8 9 10 11 12", "the capital of France", "", None]
    docs = spark.createDataFrame(list(enumerate(copies + others)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontaminate.contamination(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(i, i) for i in range(7)}
    for r in rows:
        cut = copies[r.doc_id].encode()[r.begin:r.end].decode()
        assert cut in items[r.item_id] and (r.item_id > 3 or cut == items[r.item_id].rstrip(" =?"))


def test_letters_of_other_length(spark):
    item = "the élan of école and été was seen in óbidos near the ñandú over ülm by ásta"
    # A dotted I grows and a Kelvin sign shrinks; two and one cancel out.
    assert found(spark, f"İ {item.upper()}", f"İİ K {item.upper()} ẞ Ω", f"K {item}", item=item) == {0, 1, 2}
    for text in ("ÉİÉ", "İİKÉ", "ẞΩÑ", "", "abC"):
        assert len(decontaminate.lower(text).encode()) == len(text.encode())
    assert decontaminate.lower("ÉİÉ") == "éİé"


def test_signs_tell_items_apart():
    known = decontaminate.Benchmark([1, 2], ["7 - 3", "a well-known 7"], 10)
    assert [[h[0] for h in x] for x in known.hits(["7-3", "7 + 3", "7 3", "a well known 7"])] == \
        [[1], [], [], [2]]


def test_clean_keeps_columns(spark, corpus, nothing, prose):
    items = spark.createDataFrame([(1, prose(80, 1))], "item_id long, text string")
    kept = decontaminate.clean(corpus, items)
    assert kept.columns == corpus.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id} == {2, *range(4, 16)} - {0}
    assert sum(r.doc_id is None for r in kept.collect()) == 1
    assert decontaminate.clean(nothing, items).count() == 0
    assert decontaminate.clean(corpus, items.where("false")).count() == corpus.count()


def test_large_benchmark_in_parts(spark, prose, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_BYTES", 300)
    texts = [prose(20, i) for i in range(12)]
    docs = spark.createDataFrame([(i, f"so {t} on") for i, t in enumerate(texts)],
                                 "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, items).collect()}
    assert {(i, i) for i in range(12)} <= got


def test_plan():
    r = np.random.default_rng(4)
    for size, lengths in ((100, r.integers(1, 101, 500)), (64, np.array([33] * 7 + [31] * 9 + [1] * 50)),
                          (10, np.full(25, 3)), (10, np.array([10, 10]))):
        counts = {int(k): int((lengths == k).sum()) for k in np.unique(lengths)}
        used, full = {k: [] for k in counts}, {}
        for length, begin, end, first, offset in packing.plan(counts, size):
            used[length] += range(begin, end)
            for i in range(end - begin):
                full.setdefault(first + i, []).append((offset, length))
        assert all(sorted(v) == list(range(counts[k])) for k, v in used.items())
        for pieces in full.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= size
        best = []
        for x in sorted(lengths.tolist(), reverse=True):
            fit = [i for i, left in enumerate(best) if left >= x]
            if fit:
                best[min(fit, key=best.__getitem__)] -= x
            else:
                best.append(size - x)
        assert len(full) <= len(best)


def test_packing(corpus, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    want = []
    for r in corpus.collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(str(r.doc_id), p, s, len(ids[s:s + 512]), zlib.crc32(ids[s:s + 512].tobytes()))
                 for p, s in enumerate(range(0, len(ids), 512))]
    got = packing.pack(corpus, tokenizer(), size=512)
    rows = got.collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == \
        sorted(want)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 512
    assert packing.pack(nothing, tokenizer()).count() == 0


def test_sequences(corpus):
    docs = corpus.where("doc_id > 2")
    packed = packing.pack(docs, tokenizer(), size=512)
    rows = packing.sequences(docs, packed, tokenizer(), size=512).collect()
    total = sum(r.length for r in packed.collect())
    assert sum(len(r.ids) for r in rows) == total and all(len(r.ids) <= 512 for r in rows)


@pytest.mark.parametrize("rows", [
    [(1, "u1", "x" * 300), (2, None, "x" * 300), (3, "a\r\nb", "x" * 99), (4, "u", "x" * 99),
     (5, "u", None), (6, "u", ""), (None, "u", "x" * 300), (1, "again", "x" * 300),
     (7, "u", "é\r\n\r\nWARC/1.1\r\n" * 40), (8, "u", "é\r\n\r\nWARC/1.1\r\n" * 40)], []])
def test_archive(spark, rows, monkeypatch):
    pages = spark.createDataFrame([(*r, 1) for r in rows],
                                  "page_id long, url string, html string, payload int")
    path = f"{staging_root(spark)}/archive-test-{len(rows)}-{id(rows)}"
    warc.archive(pages, path)
    got = warc.read(spark, path).collect()
    want = []
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    for i, _, h in rows:
        f = first.get(h)
        want.append((f"urn:page:{'null' if i is None else i}", len((h or "").encode()),
                     None if f is None or f == i else f"urn:page:{f}"))
    assert sorted(map(str, ((r.record_id, r.payload_length, r.refers_to) for r in got))) == \
        sorted(map(str, want))
    texts = {r.record_id: bytes(r.payload) for r in got if r.record_type == "response"}
    assert all(texts[f"urn:page:{i}"] == (h or "").encode() for i, _, h in rows
               if f"urn:page:{i}" in texts and i is not None)
    assert all(r.payload is None for r in got if r.record_type == "revisit")


def test_pushdown_and_splits(spark, monkeypatch):
    monkeypatch.setattr(warc, "SPLIT_BYTES", 1000)
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"{i % 5}" * 400) for i in range(60)],
                                  "page_id long, url string, html string")
    path = f"{staging_root(spark)}/archive-push-{id(pages)}"
    warc.archive(pages, path)
    df = warc.read(spark, path)
    assert df.count() == 60
    few = df.where("record_type = 'response' AND target_uri IN ('http://h/3', 'http://h/9')")
    assert [r.record_id for r in few.collect()] == ["urn:page:3"]
    reader = warc.WarcReader(path, df.schema, True)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    odd = GreaterThan(("payload_length",), 1)
    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), odd])) == [odd]
    monkeypatch.setattr(warc, "payload", lambda block: 1 / 0)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 55
    assert all(r.payload is None for r in warc.read(spark, path, payload=False).collect())


def test_pipeline(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert 0 < len(kept) < docs.count()
    assert len(corpus_pipeline.STAGES) == 5


def leaks(items, text):
    """Whether a window of an item, with enough plain words and consistent slots, is in the text."""
    for kind in (lambda t: decontaminate.Tokens([t]), lambda t: decontaminate.Units(decontaminate.Tokens([t]))):
        d, n = kind(text), decontaminate.WIDTH
        names = d.type == decontaminate.NAME
        views = [d.canonical.tolist(), np.where(names, d.value, d.canonical).tolist()]
        places = {}
        for view in views:
            for x in range(len(view) - n + 1):
                places.setdefault(tuple(view[x:x + n]), set()).add(x)
        for item in items:
            b = kind(item)
            plain = np.where(b.type == decontaminate.NAME, b.value, b.canonical)
            for view in (b.canonical.tolist(), plain.tolist()):
                for y in range(len(view) - n + 1):
                    words = {v for v, k in zip(b.value[y:y + n].tolist(), b.type[y:y + n], strict=True) if not k}
                    for x in places.get(tuple(view[y:y + n]), ()) if len(words) >= decontaminate.PLAIN else ():
                        pairs = {(int(k), p, q) for k, p, q in zip(
                            b.type[y:y + n], b.value[y:y + n].tolist(), d.value[x:x + n].tolist(), strict=True) if k}
                        named = {(p, q) for k, p, q in pairs if k == decontaminate.NAME}
                        if len({p for _, p, _ in pairs}) == len({(p, q) for _, p, q in pairs}) \
                                and len({q for _, q in named}) == len(named):
                            return True
    return False


def test_pipeline_stages(spark):
    from postlens.llm import quality
    from test_near import roots, shingles
    from test_repeats import gone_of
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    texts = {r.doc_id: r.text for r in docs.collect()}

    def step(name, df):
        out = stages[name](spark, df, folder).collect()
        got = {r.doc_id: r.text for r in out}
        # A stage that did nothing would be seen.
        assert got != texts
        return out, got

    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = {r.doc_id: r.text for r in quality.scored(docs, model).collect() if r.predicted == 1}
    rows, got = step("quality_classifier", docs)
    assert got == want and len(rows) == len(want)

    # Each stage takes all documents, so that it has work to do.
    sets = {k: shingles(t) for k, t in texts.items()}
    links = [(a, b) for a, x in sets.items() for b, y in sets.items()
             if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    root = roots(texts, links)
    rows, got = step("minhash_near_dedup", docs)
    assert got == {k: t for k, t in texts.items() if root[k] == k} and len(rows) == len(got)

    units = [(k, (t or "").encode()) for k, t in texts.items()]
    want = {}
    for (k, x), gone in zip(units, gone_of(units, 50), strict=True):
        if not gone.any():
            want[k] = texts[k]
        elif not gone.all():
            want[k] = bytes(np.frombuffer(x, np.uint8)[~gone]).decode("utf-8", "ignore")
    rows, got = step("suffix_array_dedup", docs)
    assert got == want and len(rows) == len(want)

    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r.text]
    want = {k: t for k, t in texts.items() if not leaks(items, t or "")}
    rows, got = step("benchmark_decontamination", docs)
    assert got == want and 0 < len(want) < len(texts) and len(rows) == len(want)

    t = Tokenizer.from_file(tokenizer())
    rows = stages["best_fit_packing"](spark, docs, folder).collect()
    ends = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == ends.get(r.doc_id, 0)
        ends[r.doc_id] = r.start + r.length
    assert ends == {k: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for k, x in texts.items()}
