import base64
import hashlib
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tessella.llm import bpe_sql, decontam, exact_dedup, html_extract, html_pages, jaccard_join, langid, license_scan, pii, token_counts, token_files

LONG = "lorem ipsum dolor " * 20_000
ODD = [None, "", " ", "a", "a" * 3000, " \n\n a  b\t\tc\r\nd ", "日本語テキスト" * 20, "it's we'll 's <|endoftext|> x", "x\0y \x1c z", "éÉ ²½ ΑΣ İ", "a b", "A b", LONG]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, very long and repeated texts, ties, and columns that clash with names used inside."""
    rows = [(i, t, "en", "s") for i, t in enumerate(ODD)] + [(3, "a", "en", "s"), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, key string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def same_rows(got, want):
    order = lambda rows: sorted(rows, key=repr)
    assert order(got) == order(want)


def test_bpe_equals_tiktoken_and_round_trips(odd, none):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = [(r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in bpe_sql.encode_decode(odd, path).collect()]
    same_rows(got, [(i, np.array(library.encode_ordinary(t), "<u4").tobytes(), t.encode()) for i, t in texts(odd)])
    back = bpe_sql.decode(bpe_sql.encode(odd, path), path)
    same_rows([(r.doc_id, bytes(r.decoded)) for r in back.collect()], [(i, t.encode()) for i, t in texts(odd)])
    assert bpe_sql.encode_decode(none, path).count() == 0


def test_every_token_encodes_to_itself_by_rising_ranks():
    """Every entry of the vocabulary is reached by contracting pairs in the order of their ranks."""
    bpe = bpe_sql.SqlBpe(P.path("byte_bpe_50k.tiktoken"))
    some = [t for t in bpe.ranks if len(t) > 1][::97]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe._merge(some)] == [[bpe.ranks[t]] for t in some]


def test_counts_equal_the_library(odd, none):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = [tuple(r) for r in token_counts.count_tokens(odd, path, table_size=5).collect()]
    same_rows(got, [(i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts(odd)])
    assert token_counts.count_tokens(none, path).count() == 0


def test_token_files_round_trip(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    out = token_files.write_token_files(docs, path, str(tmp_path / "out"), files=3)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in token_files.read_token_files(spark, out).collect()}
    start = 0
    for i, t in sorted(texts(docs)):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert got.pop(i) == (start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4
    assert not got
    empty = token_files.write_token_files(none, path, str(tmp_path / "empty"))
    assert token_files.read_token_files(spark, empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 4, 5, 999])
def test_codes_of_one_to_four_bytes(n):
    rng = np.random.default_rng(n)
    codes = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype("<u4")
    assert (token_files.unpack(*token_files.pack(codes), n) == codes).all()


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def test_exact_groups(odd, none):
    rows = texts(odd.where("doc_id is not null"))
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    want = [(i, max(groups[lowered(t)]), len(groups[lowered(t)]), i == max(groups[lowered(t)]), hashlib.sha256(lowered(t).encode()).digest()) for i, t in rows]
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest)) for r in exact_dedup.exact_groups(odd.where("doc_id is not null"), digest_all=True).collect()]
    same_rows(got, want)
    assert exact_dedup.exact_groups(none).count() == 0


def test_exact_groups_without_broadcast(odd, monkeypatch):
    few = [tuple(r)[:4] for r in exact_dedup.exact_groups(odd).collect()]
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", 0)
    same_rows([tuple(r)[:4] for r in exact_dedup.exact_groups(odd).collect()], few)


def brute_components(rows, rule):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", lowered(t)) if x]
        sets[i] = {tuple(w)} if 0 < len(w) < rule.k else {tuple(w[n : n + rule.k]) for n in range(len(w) - rule.k + 1)}
    label = {i: i for i in sets}
    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and rule.den * len(sets[a] & sets[b]) >= rule.num * len(sets[a] | sets[b]):
            low, high = sorted((label[a], label[b]))
            label = {i: low if x == high else x for i, x in label.items()}
    return [(i, len(sets[i]), label[i]) for i in sets]


@pytest.mark.parametrize("rule", [jaccard_join.Rule(3, 90, 100), jaccard_join.Rule(5, 80, 100)])
def test_components_equal_brute_force(spark, rule):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, t) for i, t in enumerate([None, "", "a b", "A  B", "one", "one two three"])]
    for group in range(6):
        base = list(rng.choice(words, 120))
        for copy in range(8):
            changed = list(base)
            for at in rng.choice(120, copy % 5, replace=False):
                changed[at] = "x" + str(rng.integers(99))
            rows.append((len(rows) * 3, " ".join(changed)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jaccard_join.similarity_components(df.withColumn("set", F.lit("clash")), rule).collect()]
    same_rows(got, brute_components([(i, t or "") for i, t in rows], rule))


def test_components_of_nothing(none):
    assert jaccard_join.similarity_components(none).count() == 0


def test_contamination_equals_brute_force(spark, odd, none):
    item = "Who was the first to cross the wide river by the old bridge? It was the miller of the lower town."
    items = spark.createDataFrame([(1, item), (2, None), (3, "completely different words that nobody ever wrote down before today"), (4, item)], "item_id long, text string")
    filler = " ".join(f"f{i}" for i in range(300))
    rows = [(110, f"{filler} {item.upper()} {filler}"), (111, item), (112, item.replace("wide", "broad")), (113, " ".join(item.split()[::-1])), (114, filler), (115, " ".join(item.split()[:12]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    got = {(r.doc_id, r.item_id) for r in decontam.find_contamination(docs, items).collect()}
    words = lambda t: [w for w in ("".join(c for c in p if c.isalnum()) for p in (t or "").lower().split()) if w]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if i.text and len(grams(words(i.text)) & grams(words(d.text))) >= 0.8 * len(grams(words(i.text)))}
    assert got == want and {(110, 1), (111, 4)} <= got and not any(d in (113, 114, 115) for d, _ in got)
    assert {r.doc_id for r in decontam.uncontaminated(docs, items).collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}
    assert decontam.find_contamination(none, items).count() == 0 and decontam.find_contamination(docs, items.where("false")).count() == 0


def test_one_word_edits_equal_brute_force():
    rng = np.random.default_rng(3)
    items = [(1, "Who was the first to cross the wide river by the old bridge of the north road? It was the miller."), (2, "one two three four five six seven eight nine"), (3, "w" + " w".join(map(str, range(40))) + ". The short answer is here"), (4, "of the sea of the sky of the sea of the land of the sea")]
    items += [(10 + n, " ".join(f"t{x}" for x in rng.integers(0, 60, n))) for n in (5, 9, 10, 14, 19, 24, 29, 44, 90)]
    words = lambda t: [decontam.term(p) for p in t.split()]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    index = decontam.ItemIndex(items, 0.8)
    texts, want = [], set()
    for key, text in items:
        w = text.split()
        for at in range(len(w)):
            for edit in (["x"], [], ["x", w[at]]):
                for before in (0, index.longest - 1):
                    texts.append(" ".join([f"f{n}" for n in range(before)] + w[:at] + edit + w[at + 1 :] + [f"g{n}" for n in range(150)]))
                    have = grams(words(texts[-1]))
                    want |= {(len(texts) - 1, k) for k, t in items if 5 * len(grams(words(t)) & have) >= 4 * len(grams(words(t)))}
    assert {row[:1] + row[1:2] for row in index.search(texts)} == want and {k for _, k in want} >= {1, 3, 34, 54, 100}


def test_licences_equal_brute_force(spark, odd, none):
    more = [(20, "Under CC BY-NC 4.0, cc by."), (21, "Permission is hereby granted, free of charge, to any person obtaining a copy of this code and associated documentation files"), (22, "gnu general public license; MIT licence; mit license"), (23, "mit " * 50), (24, "the apache license version 2.0")]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = texts(docs)
    got = sorted(license_scan.digest(license_scan.scan(docs)).collect(), key=repr)
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
        at = [(n, b.label) for b in license_scan.BASE for n in range(len(w)) if w[n : n + len(b.words)] == b.words]
        starts = [n for n, _ in at]
        want.append((i, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))))
    same_rows([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], want)
    labels = {r.doc_id: r.labels for r in got}
    assert labels[20] == "cc-by,cc-by-nc" and labels[21] == "mit" and labels[24] == "apache,apache-2.0"
    assert license_scan.scan(none).count() == 0


def test_permutations_are_one_to_one():
    for size in (1, 2, 10, 97, 1000):
        assert sorted(pii.permute(i, size, b"k", "t") for i in range(size)) == list(range(size))


def test_pseudonyms_keep_formats_and_link_values(odd, none):
    key = b"k" * 32
    text, spans = pii.pseudonymize("a.b@mail.example.com 4111 1111 1111 1111, 10.1.2.3 +1 (704) 555-7114 123-45-6789 1987-02-28 GB82 WEST 1234 5698 7654 32", key)
    assert [k for k, _, _ in spans] == ["email", "card", "ip", "phone", "ssn", "date", "iban"]
    assert re.fullmatch(r"\w\.\w@\w{4}\.\w{7}\.com \d{4} \d{4} \d{4} \d{4}, [\d.]+ \+1 \(\d{3}\) \d{3}-\d{4} \d{3}-\d\d-\d{4} 19\d\d-\d\d-\d\d GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d", text)
    assert pii.luhn(re.sub(r"\D", "", text.split(",")[0].split(" ", 1)[1])) and pii._iban_rest(text[-27:].replace(" ", "")) == 1
    assert pii.pseudonymize("4111111111111111", key)[0] == text.split(",")[0].split(" ", 1)[1].replace(" ", "")
    for clean in ("4111 1111 1111 1112", "300.1.2.3", "1987-02-30", "version 2.0.", "000-12-3456", "12345678"):
        assert pii.pseudonymize(clean, key) == (clean, [])
    got = pii.mask(odd, "key").collect()
    same_rows([(r.doc_id, r.text) for r in got], [(r.doc_id, r.text) for r in odd.collect()])
    assert all(r.n_pii == 0 for r in got) and pii.mask(none, "key").count() == 0


def test_language_of_held_out_texts(spark, odd, none):
    rng = np.random.default_rng(5)
    sounds = {"aa": "ba be bi".split(), "bb": "ba zu zi".split(), "cc": "ко ра ми".split()}
    rows = [(i, " ".join("".join(rng.choice(sounds[l], 3)) for _ in range(20)), l) for i in range(300) for l in [list(sounds)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where(~langid.held_out()), F.col("lang"))
    got = docs.join(langid.predict(docs, model), "doc_id").where(langid.held_out()).collect()
    assert len(got) > 40 and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    edge = langid.predict(odd, model).collect()
    assert all(0 <= r.score <= 1 for r in edge) and all((r.lang_pred == "und") == (not any(c.isalpha() for c in t)) for r, (_, t) in zip(sorted(edge, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(texts(odd), key=lambda x: (x[0] is None, x[0]))))
    assert langid.fit(docs.where("false"), F.col("lang")).labels == () and langid.predict(none, model).count() == 0
    assert langid.accepted(odd, model, 0.0).columns == odd.columns
    assert {zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs.where(langid.held_out()).collect()} == {True}


def test_texts_in_no_learned_language_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()), F.col("lang"))
    other = {
        "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "pl": "Wszyscy ludzie rodzą się wolni i równi w swojej godności i prawach. Są oni obdarzeni rozumem i sumieniem.",
        "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
        "zh": "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心。",
        "letters": "".join(np.random.default_rng(1).choice(list("abcdefghijklmnopqrstuvwxyz   "), 600)),
        "short ru": "Да, конечно.",
    }
    rows = [(f"{k} {n}", " ".join([t] * n)) for k, t in other.items() for n in (1, 40)]
    assert langid.accepted(spark.createDataFrame(rows, "doc_id string, text string"), model, 0.3).collect() == []
    clean = docs.where(langid.held_out() & F.col("text").rlike(r"\p{L}"))
    whole = clean.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    short = whole.select("doc_id", F.substring("text", 1, 30).alias("text")).where(r"text rlike '^[\\p{L} .,\n]{30}$'")
    for part in (whole, short):
        assert part.count() > 100 and langid.accepted(part, model, 0.3).count() == part.count()


@pytest.fixture(scope="module")
def model():
    return html_extract.train()


def test_main_text_of_pages(spark, model):
    page = '<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div><article><h1>A title</h1><p><b>First &amp; best<br>line<p>Second\n  one &lt;here</p><script>var x = "</p>";</script></article><section id="comments"><div class="comment"><p>Nice article, thank you.</p></div></section><aside><p>Related things to read.</p></aside><footer>&copy; me</footer></body></html>'
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<p"), (5, "u", page[:700]), (1, "u", page), (6, "u", "<article>" + "<p>word word word.</p>" * 3000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in html_extract.extract(pages, model).collect()}
    assert got[1] == "A title\n\nFirst & best line\n\nSecond one <here"
    assert got[2] == got[3] == got[4] == "" and got[6].count("word") == 9000
    assert html_extract.extract(pages.where("false"), model).count() == 0


@pytest.mark.parametrize("n", [10, 63, 64, 200])
def test_a_lone_child_has_no_equal_siblings(n):
    tree = html_extract.Tree("<html><body><div>" + "<p>some words of a paragraph</p>" * n + "<h2>a heading</h2></div></body></html>")
    same = html_extract.node_features(tree)[:, 13]
    tags = [x.tag for x in tree.nodes]
    assert tags.count("p") == n and {same[i] for i, t in enumerate(tags) if t == "p"} == {min(n, 12)} and same[tags.index("h2")] == 1


def test_main_text_of_held_out_pages(model):
    right = total = 0
    for page, marker in html_pages.labelled_pages(60, seed=11):
        tree = html_extract.Tree(page)
        kept = html_extract.decode(tree, model.log_odds(html_extract.node_features(tree)))
        assert all(kept[x.parent] for i, x in enumerate(tree.nodes) if i and kept[i])
        for n, text in tree.segments:
            right += (marker in text) == kept[n]
            total += 1
    assert right >= 0.97 * total


def test_long_words_equal_tiktoken():
    import random

    import tiktoken

    path, r = P.path("byte_bpe_50k.tiktoken"), random.Random(1)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = sorted(t.decode() for t in ranks if t.isalpha() and t.isascii())
    word = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    cases = ["=" * n for n in (63, 64, 65, 128, 129, 1000, 5003)] + [" " * 130 + "x", "-=" * 700, "abc" * 999, "日本" * 900]
    cases += ["".join(r.sample(tokens, 60)) for _ in range(100)] + [word("ae", r.randint(50, 400)) for _ in range(100)]
    cases += [" ".join(word("abcdefghijklmnopqrstuvwxyz", 45) for _ in range(8000)), word("abcdefghijklmnopqrstuvwxyzABC", 200_000)]
    bpe = bpe_sql.SqlBpe(path, cache_keys=2000)
    got = bpe.encode(cases)
    assert got == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in cases]
    assert bpe.decode(got) == [t.encode() for t in cases]


def test_pieces_equal_the_library():
    import random

    from tokenizers import Tokenizer

    path, r = P.path("word_bpe_49k.json"), random.Random(2)
    library, own = Tokenizer.from_file(path), token_files.WordEncoder(path)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 211 == 0)]
    latin = [chr(c) for c in [*range(0x20, 0x7F), *range(0xC0, 0x180)]]
    cases = [chr(c) for c in points] + ["İᢩ", "̵᫈", "₟“", "΍₞"]
    cases += ["".join(chr(r.choice(points)) for _ in range(r.randint(1, 12))) for _ in range(10_000)]
    cases += ["".join(r.choice([*latin, "Σ", "́", "\x85"]) for _ in range(r.randint(1, 20))) for _ in range(10_000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(cases)] == [e.ids for e in library.encode_batch(cases, add_special_tokens=False)]


def test_copies_with_words_put_in_are_found(spark, monkeypatch):
    words = [f"t{i}" for i in range(100)]
    items = spark.createDataFrame([(None, " ".join(words)), (7, "x y z u v w"), (7, "x y z u v w")], "item_id long, text string")
    rows = [(at, " ".join([*(f"f{i}" for i in range(at)), *words[:50], *(f"g{i}" for i in range(40)), *words[50:], *(f"h{i}" for i in range(200))])) for at in range(0, 130, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(decontam, "SHARD_ITEMS", 1)
    got = [(r.doc_id, r.item_id) for r in decontam.find_contamination(docs, items).collect()]
    same_rows(got, [(i, None) for i, _ in rows])
    assert decontam.uncontaminated(docs, items).count() == 0


def test_components_of_a_hot_group_equal_brute_force(spark, monkeypatch):
    """A large group of near copies about the threshold, exact copies of a third of all rows, and a passage that all share."""
    rng = np.random.default_rng(8)
    monkeypatch.setattr(jaccard_join, "HOT_SHARE", 100_000)
    base, rows = [f"w{i}" for i in range(80)], []
    for n in range(220):
        changed = list(base)
        for at in rng.choice(80, 1 + n % 4, replace=False):
            changed[at] = f"x{rng.integers(10_000)}"
        rows.append((1000 - n, " ".join(changed)))
    rows += [(2000 + n, "one and the same text of some words") for n in range(110)] + [(3000, None), (3001, ""), (3002, " ".join(f"y{i}" for i in range(5000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rule in (jaccard_join.Rule(3, 90, 100), jaccard_join.Rule(5, 80, 100)):
        got = [tuple(r) for r in jaccard_join.similarity_components(df, rule).collect()]
        same_rows(got, brute_components([(i, t or "") for i, t in rows], rule))
    odd_ids = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (5, "e f g"), (4, "e f g")], "doc_id long, text string")
    got = [tuple(r) for r in jaccard_join.similarity_components(odd_ids, jaccard_join.Rule(3, 90, 100)).collect()]
    same_rows(got, [(None, 2, None), (None, 2, None), (5, 2, 5), (5, 1, 4), (4, 1, 4)])


@pytest.mark.parametrize("part", ['<svg viewBox="0"/>', "<math/>", '<svg><path d="x"/><title/><g><circle r=1 /></g></svg>', '<svg><path d="M0">', "<svg><style>a{}</style><foreignObject><p>in</p></foreignObject></svg>"])
def test_svg_and_math_take_no_text_with_them(model, part):
    article = "<p>" + "Some good words in the article go here. " * 8 + "</p>"
    page = "<html><body><nav><a href=x>m</a></nav><article><h1>Title</h1>{}" + article * 2 + "</article><footer>f</footer></body></html>"
    assert html_extract.main_texts([page.format(part)], model) == html_extract.main_texts([page.format("")], model)


def test_rows_without_id(spark):
    rows = [(None, "a"), (3, "A"), (None, "b"), (None, "b")]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same_rows([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got], [(None, 3, 2, False), (3, 3, 2, True), (None, None, 2, True), (None, None, 2, True)])


def test_counting_shuffles_nothing(odd):
    plan = token_counts.count_tokens(odd.coalesce(1), P.path("byte_bpe_50k.json"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_long_texts_with_much_personal_data():
    text = " ".join(f"u{i}@mail.example.com" for i in range(3000))
    new, spans = pii.pseudonymize(text, b"k" * 32)
    assert len(spans) == 3000 and len(new) == len(text) and len(set(new.split())) == 3000
