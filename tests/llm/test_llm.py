"""Operators against brute force, exact round trips and held-out accuracy, on small tables with awkward rows."""

import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.llm import forest, html, langid, lines, near_dup, packing, substrings, tiling, toxicity, wordpiece
from netloom.llm.common import components

SCHEMA = "doc_id long, text string, lang string, row_key int, gone string, node string"
SYLLABLES = "ba be bi bo bu da de di do du ka ke ki ko ku".split()


def prose(rng, n, words=None):
    words = words or ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(400)]
    return " ".join(rng.choices(words, k=n))


def table(spark, texts):
    """Texts as rows with clashing extra columns; entries are texts or (id, text)."""
    rows = [(*t, "en", 1, "x", "y") if isinstance(t, tuple) else (k, t, "en", 1, "x", "y") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def awkward(rng):
    base = prose(rng, 120)
    return [base, base, None, "", " \n ", "one", "a b c", prose(rng, 5000), base + " " + prose(rng, 3), " x y z\x1cw", prose(rng, 60) + "\n" + base]


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [*awkward(random.Random(1)), "Don't STOP, it's 12.5% <|endoftext|> é İstanbul ΣΣ 日本語 #$% x_y", (0, "the same id"), (None, "no id")]
    out = packing.pack(table(spark, texts)).withColumn("crc", F.crc32("ids")).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    expected = sorted(tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for t in (x[1] if isinstance(x, tuple) else x for x in texts))
    assert len({r["sequence_id"] for r in out}) == len(out) and all(r["offset"] == 0 for r in out)
    docs, row = [], []
    for r in sorted(out, key=lambda r: (r["sequence_id"] & ((1 << 57) - 1))):
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] == r["bucket"] <= 4096 and r["length"] & (r["length"] - 1) == 0 and r["crc"] == zlib.crc32(r["ids"])
        assert r["start"] == len(row)
        row += ids.tolist()
        if len(row) == r["doc_tokens"]:
            docs.append(tuple(row))
            row = []
    assert sorted(docs) == expected
    assert packing.pack(empty(spark)).count() == 0
    assert packing.pieces_of(4096 * 2 + 5, 4096) == [4096, 4096, 4, 1]


def brute_substrings(texts, size):
    rows = [(t if isinstance(t, tuple) else (k, t)) for k, t in enumerate(texts)]
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - size + 1):
            if i is not None:
                first[tuple(w[k : k + size])] = min(i, first.get(tuple(w[k : k + size]), i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def test_substrings_equal_brute_force(spark):
    rng = random.Random(2)
    texts = awkward(rng)
    shared = prose(rng, 70)
    texts += [f"{prose(rng, 30)} {shared} {prose(rng, 20)}" for _ in range(6)] + [shared, (3, shared), (None, shared), ("b b " * 200).strip(), ("b b " * 150).strip()]
    out = substrings.remove_repeats(table(spark, texts))
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect()), key=str) == brute_substrings(texts, 50)
    assert substrings.remove_repeats(empty(spark)).count() == 0


def test_substrings_do_not_depend_on_the_sketch_width(spark):
    rng = random.Random(12)
    shared = prose(rng, 80)
    texts = [f"{prose(rng, rng.randint(0, 90))} {shared if rng.random() < 0.5 else ''} {prose(rng, rng.randint(0, 90))}" for _ in range(40)]
    want = brute_substrings(texts, 50)
    for width in (64, 1 << 16, 1 << 20):  # crowded, several slices
        out = substrings.remove_repeats(table(spark, texts), width=width)
        assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect()), key=str) == want


def test_merged_sketches_never_underestimate(spark):
    rng = random.Random(13)
    texts = [prose(rng, 70) for _ in range(60)]
    texts += texts[:25]
    width = 1 << 20
    rows = substrings.merged_sketch(table(spark, texts).repartition(7), 50, 12, width)
    w, times = substrings.Windows(50, 12), {}
    for t in texts:
        for a in np.unique(w.anchors(w.words(t)[1])).tolist():
            times[a] = times.get(a, 0) + 1
    marked = {a: all(np.unpackbits(bits)[int(substrings.cells_of(np.array([a], np.uint64), k, width)[0])] for k, bits in enumerate(rows)) for a in times}
    assert all(marked[a] for a, n in times.items() if n > 1)
    assert sum(marked[a] for a, n in times.items() if n == 1) <= 0.05 * len(times)


def brute_near(texts, size=5, similarity=75):
    sets = []
    for t in texts:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        sets.append({tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))} if w else set())
    low = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= similarity * (len(sets[a]) + len(sets[b]) - both):
            x, y = low[a], low[b]
            low = [min(x, y) if z in (x, y) else z for z in low]
    return [(k, len(s), low[k], low[k] == k) for k, s in enumerate(sets)]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    texts = awkward(rng)
    for _ in range(12):
        base = prose(rng, rng.randint(20, 200)).split()
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = "zz" + str(rng.random())
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
            if rng.random() < 0.5:
                base = copy
    out = near_dup.near_duplicates(table(spark, texts)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out) == brute_near(texts)
    assert near_dup.near_duplicates(empty(spark)).count() == 0
    odd = near_dup.near_duplicates(table(spark, [(None, "a b"), (None, "a b"), (5, "a b"), (5, "c d"), (7, "c d")])).collect()
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in odd), key=str) == sorted([(None, None, True), (None, None, True), (5, 5, True), (5, 5, True), (7, 5, False)], key=str)


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(8, 40)] + [(50, 7)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[k] == 100 for k in range(100, 161)) and all(out[k] == 7 for k in (*range(7, 40), 50))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def edit(a, b):
    row = list(range(len(b) + 1))
    for x, c in enumerate(a, 1):
        last, row[0] = row[0], x
        for y, d in enumerate(b, 1):
            last, row[y] = row[y], min(row[y] + 1, row[y - 1] + 1, last + (c != d))
    return row[-1]


def brute_lines(spark, texts, radius=lines.RADIUS, similarity=0.8, edits_alone=False):
    """All pairs of contents that share a key of two blocks, are near enough and similar by edits."""
    import regex

    norm = lambda x: " ".join(regex.findall(r"[\p{L}\p{N}]+", x.lower()))
    places = [(k, n, norm(x)) for k, t in enumerate(texts) for n, x in enumerate((t or "").split("\n")) if norm(x)]
    vocabulary = sorted({w for *_, x in places for w in x.split(" ")})
    hashes = dict(spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", F.xxhash64("w")).collect()) if vocabulary else {}

    def sim(x):
        out, different = [], set(x.split(" "))
        for half in (0, 1):
            for place in range(4):
                ws = [hashes[w] for w in different if hashes[w] & 1 == half and hashes[w] >> 1 & 3 == place]
                out.append((sum(1 << b for b in range(16) if 2 * sum(h >> 48 + b & 1 for h in ws) > len(ws)), len(ws)))
        return out, len(different)

    def candidates(p, q):
        (p, n), (q, m) = p, q
        same = [k for k in range(8) if p[k][0] == q[k][0] != 0]
        key = lambda x, words, i, j: words < lines.SHORT or (i // 4 == j // 4 and x[i][1] + x[j][1] >= 3)
        agree = any(key(p, n, i, j) and key(q, m, i, j) for i, j in combinations(same, 2))
        return agree and sum((x ^ y).bit_count() for (x, _), (y, _) in zip(p, q)) <= radius + lines.MORE * (min(n, m) < lines.SHORT)

    def alike(a, b):
        if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
            return False
        return edit(a, b) <= int((1 - similarity) * max(len(a), len(b)) + 1e-9)

    contents = sorted({x for *_, x in places})
    sims, root = {x: sim(x) for x in contents}, {x: x for x in contents}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(contents, 2):
        if (edits_alone or candidates(sims[a], sims[b])) and alike(a, b):
            root[find(a)] = find(b)
    first = {}
    for k, n, x in places:
        first.setdefault(find(x), (k, n))
    gone = {(k, n) for k, n, x in places if first[find(x)] != (k, n)}
    return [(k, t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (k, n) not in gone), len(t.split("\n")) if t is not None else 0, sum(a == k for a, _ in gone)) for k, t in enumerate(texts)]


def test_lines_equal_brute_force(spark):
    rng = random.Random(4)
    pool = [prose(rng, rng.randint(1, 40)) for _ in range(12)]
    for x in pool[:8]:
        w = x.split()
        w[rng.randrange(len(w))] = "zu"
        pool += [" ".join(w), x.upper() + "!", " ".join(reversed(x.split()))]
    texts = ["\n".join(rng.choices([*pool, "", "---"], k=rng.randint(1, 8))) for _ in range(20)] + [None, "", "\n\n", "---\n---", prose(rng, 3000)]
    out = lines.drop_fuzzy_lines(table(spark, texts)).collect()
    assert sorted((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out) == brute_lines(spark, texts)
    assert lines.drop_fuzzy_lines(empty(spark)).count() == 0
    kept = lines.drop_fuzzy_lines(table(spark, ["a b", "a b"]), keep=("row_key", "gone")).orderBy("doc_id").select("doc_id", "text", "rest.*").collect()
    assert [tuple(r) for r in kept] == [(0, "a b", 1, "x"), (1, "", 1, "x")]


def test_lines_of_one_simhash_are_compared(spark):
    rng = random.Random(24)
    groups = []
    for _ in range(4):
        a = ["".join(rng.choices(SYLLABLES, k=4)) for _ in range(16)]
        b = a[:8][::-1] + a[8:][::-1]
        c = b.copy()
        c[2], c[3] = c[3], c[2]
        groups.append([" ".join(x) for x in (a, a, a, b, c)])
    texts = [x for g in groups for x in g]
    out = lines.drop_fuzzy_lines(table(spark, texts)).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in out] == [0, 1, 1, 0, 1] * 4 == [r[3] for r in brute_lines(spark, texts)]


def test_permuted_and_edited_lines_equal_brute_force(spark):
    rng = random.Random(25)
    texts = []
    for _ in range(5):
        base = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(4, 20))]
        for _ in range(14):
            w = base.copy()
            for _ in range(rng.randint(0, 3)):
                k, m = rng.randrange(len(w)), rng.randrange(len(w))
                if rng.random() < 0.5:
                    w[k], w[m] = w[m], w[k]
                else:
                    w[k] = "zu" + w[k][1:]
            texts.append(" ".join(w))
    out = lines.drop_fuzzy_lines(table(spark, texts)).collect()
    assert sorted((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out) == brute_lines(spark, texts)


def test_lines_with_one_edit_are_found(spark):
    """An edit within one half leaves the other half's blocks alone, whatever the line's length: recall against edits alone."""
    rng = random.Random(26)
    texts = []
    for n in (4, 6, 9, 14, 20, 35, 60) * 3:
        w = ["".join(rng.choices(SYLLABLES, k=3)) for _ in range(n)]
        texts.append(" ".join(w))
        w[rng.randrange(n)] = "zuzu"
        texts.append(" ".join(w))
    found = sum(r["n_removed"] for r in lines.drop_fuzzy_lines(table(spark, texts)).collect())
    wanted = sum(r[3] for r in brute_lines(spark, texts, edits_alone=True))
    print("found", found, "by edits alone", wanted)
    assert found >= 0.9 * wanted


def test_recall_by_kind_of_edit(spark):
    """Against edits alone, for each kind of edit in lines of 6 to 60 words; three typos in fewer than 13 words are
    found less often, which the README states: no bound is asserted for them."""
    rng = random.Random(28)
    word = lambda: "".join(rng.choices(SYLLABLES, k=rng.choice((1, 2, 2, 3, 3, 4))))

    def typo(w):
        k = rng.randrange(len(w))
        at = rng.randrange(len(w[k]))
        w[k] = w[k][:at] + rng.choice("xyz") + w[k][at + 1 :]

    def replace(w):
        w[rng.randrange(len(w))] = word()

    def insert(w):
        w.insert(rng.randrange(len(w) + 1), word())

    def delete(w):
        del w[rng.randrange(len(w))]

    kinds = {"one replaced": [replace], "two replaced": [replace] * 2, "one inserted": [insert], "one deleted": [delete], "one typo": [typo], "two typos": [typo] * 2, "three typos": [typo] * 3}
    texts, of = [], {}
    for name, edits in kinds.items():
        for low, high in ((6, 12), (13, 30), (31, 60)):
            for _ in range(20):
                a = [word() for _ in range(rng.randint(low, high))]
                b = a.copy()
                for f in edits:
                    f(b)
                a, b = " ".join(a), " ".join(b)
                if a != b and edit(a, b) <= 0.2 * max(len(a), len(b)):
                    of[len(texts) + 1] = name, low
                    texts += [a, b]
    gone = {r["doc_id"] for r in lines.drop_fuzzy_lines(table(spark, texts)).where("n_removed > 0").select("doc_id").collect()}
    assert gone <= set(of)
    for kind in sorted(set(of.values())):
        ids = [k for k, x in of.items() if x == kind]
        recall = sum(k in gone for k in ids) / len(ids)
        print(kind, len(ids), round(recall, 2))
        assert len(ids) < 5 or kind == ("three typos", 6) or recall >= 0.85, (kind, len(ids), recall)
    some = [k for k, x in of.items() if x != ("three typos", 6)]
    assert sum(k in gone for k in some) >= 0.9 * len(some)


def test_very_long_lines(spark):
    rng = random.Random(27)
    long_ = prose(rng, 20_000)
    words_ = long_.split()
    words_[77] = "zzzz"
    out = lines.drop_fuzzy_lines(table(spark, [long_, " ".join(words_), prose(rng, 20_000), long_.upper()])).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in out] == [0, 1, 0, 1]


def test_word_pieces_are_greedy():
    rng = random.Random(5)
    for _ in range(3000):
        begin, follow = ({"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 6))} for _ in range(2))
        word, at, n, known = "".join(rng.choices("abc", k=rng.randint(1, 10))), 0, 0, begin
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
            if end is None:
                n = 0
                break
            at, n, known = end, n + 1, follow
        assert wordpiece.Automaton(sorted(begin), sorted(follow)).count(word) == n


def test_token_counts(spark):
    out = wordpiece.token_counts(table(spark, ["ab abc x", None, "", "abab"]), ["a", "ab"], ["b", "c", "ab"]).orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [(0, 3, 4, 1), (1, 0, 0, 0), (2, 0, 0, 0), (3, 1, 2, 0)]
    assert wordpiece.token_counts(empty(spark), ["a"], []).count() == 0


PAGE = "<html><head><title>T</title><script>if (a<b) x='<p>no</p>'</script></head><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies</div><{0}><h1>Head</h1><p>One &amp; two<br>three\n  four<p>Five <a href=x>six</a></{0}><div id=comments><p>first!!</p></div><form><input>Send</form><footer>&copy; me</footer></body></html>"


def test_html_extraction(spark):
    pages = [(k, f"https://www.h{k % 2}.org:80/{k}", PAGE.format(("article", "div class=main")[k % 2]).replace("</div class=main>", "</div>")) for k in range(8)]
    pages += [(8, "https://h1.org/short", "<body><div class=other>" + "long text " * 20 + "</div></body>"), (9, None, "<p>no host"), (10, "https://h1.org/null", None), (11, "x", ""), (8, "https://h0.org/again", PAGE.format("article"))]
    out = html.main_text(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, path int")).collect()
    got = {(r["page_id"], r["url"]): r["text"] for r in out}
    want = "Head\nOne & two\nthree four\nFive six"
    assert len(out) == len(pages) and all(got[p[0], p[1]] == want for p in pages[:8]) and got[8, "https://h0.org/again"] == want
    assert got[8, "https://h1.org/short"] == ("long text " * 20).strip() and got[9, None] == "no host" and got[10, "https://h1.org/null"] == got[11, "x"] == ""
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_keeps_the_whole_article(spark):
    p = "<p>" + "word " * 30 + "</p>"
    pages = {
        "nested": (f"<body><article><h1>Head</h1><p>lead</p><div class=entry><div class=content>{p}<figcaption>caption</figcaption></div></div></article></body>", ["Head", "lead", "caption"]),
        "siblings": (f"<body><div class=menu>Menu</div><div class=post>{p}</div><div class=post2>{p.replace('word', 'other')}</div></body>", ["word", "other"]),
        "intro": (f"<body><div class=post><div class=intro>intro intro intro intro intro</div><div class=content>{p}</div></div></body>", ["intro", "word"]),
        "inside": (f"<body><article>{p}<div class=side><p>beside</p></div></article></body>", ["word", "beside"]),
    }
    rows = [(k, f"https://h{k % 2}.org/{k}", html_, name) for k, (name, (html_, _)) in enumerate(pages.items())]
    # Of a host with two templates, the rarer keeps its own article though it has a small box on the winning path.
    rows += [(100 + k, f"https://two.org/{k}", f"<body><div class=main>{p}</div></body>", "") for k in range(6)]
    rows += [(200, "https://two.org/x", f"<body><div class=main>box</div><section class=story>{p.replace('word', 'story')}</section></body>", "")]
    out = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    for k, (name, (_, wanted)) in enumerate(pages.items()):
        assert all(x in out[k] for x in wanted) and "Menu" not in out[k], (name, out[k])
    assert "story" in out[200]


def test_languages_without_letters_or_with_one_text(spark):
    rng = random.Random(16)
    make = lambda: " ".join("".join(rng.choices("tor mel sin dak".split(), k=2)) for _ in range(40))
    rows = [(k, make(), "aa") for k in range(60)] + [(100 + k, "12 34 ²", "bb") for k in range(5)] + [(200 + k, f"lo uni apra {k}", f"c{k}") for k in range(6)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert "bb" not in model.langs and {"aa", *(f"c{k}" for k in range(6))} == set(model.langs)
    out = [r["lang_pred"] for r in langid.identify(table(spark, ["² ½", "Ⅷ ①", make(), None]), model).orderBy("doc_id").collect()]
    assert out == ["und", "und", "aa", "und"]
    assert langid.train(spark.createDataFrame([(1, "12", "aa")], "doc_id long, text string, lang string")).langs == []


def reference_kneser_ney(words, order):
    """Interpolated Kneser-Ney by dictionaries, from the definition: p(c | context) by recursion."""
    full = {}
    for w in words:
        framed = langid.MARK + w + langid.MARK
        for end in range(2, len(framed) + 1):
            g = framed[max(0, end - order) : end]
            full[g] = full.get(g, 0) + 1
    level = {order: {g: n for g, n in full.items() if len(g) == order}}
    for n in range(order - 1, 0, -1):
        counts = {g: c for g, c in full.items() if len(g) == n and g[0] == langid.MARK and n > 1}
        for g in level[n + 1]:
            if g[1:] not in full or len(g[1:]) < 2 or g[1] != langid.MARK:
                if not (n > 1 and g[1] == langid.MARK):
                    counts[g[1:]] = counts.get(g[1:], 0) + 1
        level[n] = counts

    def p(context, c, n):
        if n == 1:
            total, kinds = sum(level[1].values()), len(level[1])
            return max(level[1].get(c, 0) - 0.75, 0) / total + 0.75 * kinds / total / (kinds + 1)
        own = {g: k for g, k in level[n].items() if g[:-1] == context}
        if not own:
            return p(context[1:], c, n - 1)
        ones, twos = (sum(k == x for k in level[n].values()) for x in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        return max(own.get(context + c, 0) - d, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * p(context[1:], c, n - 1)

    return full, p


def test_kneser_ney_equals_its_definition():
    words_ = ["tormel", "torsin", "melmel", "dak", "tor", "sinmel"]
    full, p = reference_kneser_ney(words_, 3)
    t = langid.kneser_ney(full, 3)
    for w in ("tormel", "daksin", "xtor"):
        framed = langid.MARK + w + langid.MARK
        codes = langid.codes_of(framed)
        costs = t.costs(langid.gram_hashes(codes, 3), np.arange(len(codes)) + 1)
        for k in range(1, len(framed)):
            n = min(3, k + 1)
            assert np.exp(-costs[k]) == pytest.approx(p(framed[k - n + 1 : k], framed[k], n), rel=1e-9)


def test_language_identification(spark):
    rng = random.Random(6)
    sets = {"aa": "tor mel sin dak".split(), "bb": "lo uni apra ese".split()}
    make = lambda lang, n: " ".join("".join(rng.choices(sets[lang], k=rng.randint(1, 3))) for _ in range(n))
    train = spark.createDataFrame([(k, make(("aa", "bb")[k % 2], 60), ("aa", "bb")[k % 2]) for k in range(120)] + [(900, None, "aa"), (901, "tor", None)], "doc_id long, text string, lang string")
    model = langid.train(train)
    texts = [make(("aa", "bb")[k % 2], 30) for k in range(40)] + [None, "", "12 34!", "日本語の文章 " * 30, make("aa", 4000)]
    out = {r["doc_id"]: r for r in langid.identify(table(spark, texts), model).collect()}
    assert all(out[k]["lang_pred"] == ("aa", "bb")[k % 2] and not out[k]["rejected"] and 0.5 < out[k]["score"] <= 1 for k in range(40))
    assert all(out[k]["lang_pred"] == "und" and out[k]["rejected"] and out[k]["score"] == 0 for k in (40, 41, 42))
    assert out[43]["rejected"] and out[44]["lang_pred"] == "aa" and not out[44]["rejected"]
    assert langid.identify(empty(spark), model).count() == 0
    nothing = langid.train(train.where("false"))
    assert [r["lang_pred"] for r in langid.identify(table(spark, ["tor"]), nothing).collect()] == ["und"]


def test_languages_that_were_not_learned_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out()).where("lang <> 'de'"))
    found = langid.identify(docs, model).join(docs.select("doc_id", "lang", langid.held_out().alias("held")), "doc_id").collect()
    alien, clean = ([r["rejected"] for r in found if (r["lang"] == "de") == german and (german or r["held"])] for german in (True, False))
    print("left out and rejected", sum(alien), len(alien), "clean and rejected", sum(clean), len(clean))
    assert sum(alien) >= 0.9 * len(alien) and sum(clean) <= 0.02 * len(clean)
    short = langid.identify(table(spark, ["日本語の文", "xqzw kjx"]), model).collect()
    assert all(r["rejected"] for r in short)


def test_kneser_ney_sums_to_one():
    grams = {}
    for w in ("tormel", "torsin", "melmel", "dak"):
        framed = langid.MARK + w + langid.MARK
        for end in range(2, len(framed) + 1):
            g = framed[max(0, end - 3) : end]
            grams[g] = grams.get(g, 0) + 1
    model = langid.Model(["x"], [langid.kneser_ney(grams, 3)], 3)
    letters = sorted(set("tormelsindak"))
    t = model.tables[0]

    def p(context, c):
        codes = langid.codes_of(context + c)
        cost = t.costs(langid.gram_hashes(codes, 3), np.arange(1, len(codes) + 1))
        return float(np.exp(-cost[-1]))

    for context in (langid.MARK + "t", "or", "el", "zz"):
        total = sum(p(context, c) for c in [*letters, langid.MARK, "?"])  # ? stands for the one unknown letter
        assert total == pytest.approx(1, abs=1e-6)


def brute_tiles(a, b, least):
    """Longest first, then first in a, then in b, by trying all places."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return sorted(out)
        for k in range(n):
            free_a[i + k] = free_b[j + k] = False
        out.append((i, j, n))


def test_tiling_equals_brute_force():
    rng = random.Random(7)
    for _ in range(400):
        a, b = ([rng.randint(1, 4) for _ in range(rng.randint(0, 40))] for _ in range(2))
        least = rng.randint(1, 5)
        got = tiling.tile(np.array(a, np.int64), np.array(b, np.int64), least)
        assert sorted(got) == brute_tiles(a, b, least)


def test_decontamination(spark):
    rng = random.Random(8)
    item = prose(rng, 40).split()
    swapped = " ".join(item[20:] + ["and", "now"] + item[:20])
    texts = [f"{prose(rng, 50)} {' '.join(item).upper()}. {prose(rng, 20)}", swapped, " ".join(item[:20]), prose(rng, 300), None, "", prose(rng, 4000) + " " + swapped]
    bench = spark.createDataFrame([(1, " ".join(item), 0), (2, None, 0), (3, "", 0), (4, "two words", 0)], "item_id long, text string, coverage int")
    out = tiling.contaminated(table(spark, texts), bench)
    assert sorted((r["doc_id"], r["item_id"]) for r in out.collect()) == [(0, 1), (1, 1), (6, 1)]
    assert tiling.contaminated(empty(spark), bench).count() == 0 and tiling.contaminated(table(spark, texts), bench.where("false")).count() == 0


def test_rule_statistics():
    text = "a b c a b c\nx #1\nx #1\n\n \nx #1 <&>"
    w = words(text)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    covered = {k + d for k, x in enumerate(windows) if windows.count(x) > 1 for d in range(3)}
    assert forest.statistics_of(text) == (len(w), sum(map(len, w)), 6, 1, len(covered))
    assert forest.statistics_of(None) == forest.statistics_of("") == (0, 0, 0, 0, 0)


def test_forest_finds_what_labels_call_bad(spark):
    rng = random.Random(9)
    good = [prose(rng, 100 + k) for k in range(300)]
    bad = [" ".join(w + "###" for w in prose(rng, 100 + k).split()) for k in range(30)]
    docs = table(spark, [*good, *bad, None, "", "w " * 400, "short text"])
    labels = spark.createDataFrame([(k, int(k < 300)) for k in range(0, 330, 2)] + [(None, 1), (1, None)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in forest.judge(docs, labels).collect()}
    assert sum(out[k]["kept"] for k in range(300)) >= 298 and not any(out[k]["kept"] for k in range(300, 334))
    assert all(out[k]["base_failed"] for k in range(330, 334))
    assert all(r["kept"] == (not r["base_failed"]) for r in forest.judge(docs, labels.where("false")).collect())
    assert forest.judge(empty(spark), labels).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(10)
    vile = ["grubnak", "snorfel", "blightok"]
    texts = [prose(rng, 80) + (" " + " ".join(rng.choices(vile, k=4)) if k % 5 == 0 else "") for k in range(400)]
    docs = table(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(300)] + [(None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs.where("doc_id < 300").select("doc_id", "text"), labels)
    out = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    right = sum((out[k] >= 0.5) == (k % 5 == 0) for k in range(300, 400))
    assert right >= 95, right
    assert out[400] < 0.5 and out[401] < 0.5
    nothing = toxicity.learn(docs, labels.where("false"))
    assert all(0 < r["score"] < 0.5 for r in toxicity.score(docs, nothing).collect())
    assert toxicity.score(empty(spark), model).count() == 0


def test_toxicity_follows_the_label_model(spark, monkeypatch):
    rng = random.Random(17)
    vile = ["grubnak", "snorfel", "blightok"]
    texts = [prose(rng, 60) + (" " + " ".join(rng.choices(vile, k=4)) if k % 5 == 0 else "") for k in range(300)]
    docs, labels = table(spark, texts), spark.createDataFrame([(k, int(k % 5 == 0), "x") for k in range(0, 300, 3)], "doc_id long, toxic int, text string")
    right = lambda model: sum((r["score"] >= 0.5) == (r["doc_id"] % 5 == 0) for r in toxicity.score(docs, model).collect())
    assert right(toxicity.learn(docs, labels)) >= 290
    monkeypatch.setattr(toxicity.LabelModel, "posterior", lambda self, votes: np.full(len(votes), 0.5))
    blind = toxicity.learn(docs, labels)
    assert np.abs(blind.weight).max() < 0.2 and right(blind) < 290


def test_label_model_finds_the_rates_of_planted_voters():
    rng = np.random.default_rng(18)
    y = rng.random(6000) < 0.2
    toxic, clean = np.array([0.9, 0.8, 0.7, 0.6]), np.array([0.05, 0.1, 0.02, 0.3])
    votes = (rng.random((6000, 4)) < np.where(y[:, None], toxic, clean)).astype(float)
    masks, counts = np.unique(votes @ [1, 2, 4, 8], return_counts=True)
    model = toxicity.fit_label_model(toxicity.bits(masks.astype(int), 4), counts, votes[:60], y[:60].astype(int))
    assert np.abs(model.toxic - toxic).max() < 0.12 and np.abs(model.clean - clean).max() < 0.05 and abs(model.prior - 0.2) < 0.05
    assert ((model.posterior(votes) >= 0.5) == y).mean() > 0.93


def test_toxicity_learns_from_odd_tables(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, toxic int")
    for docs in (empty(spark), table(spark, [(1000 + k, "some text here") for k in range(5)]), table(spark, [None] * 20)):
        model = toxicity.learn(docs, labels)
        assert all(0 <= r["score"] <= 1 for r in toxicity.score(table(spark, [None, "", "a b"]), model).collect())


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(19)
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(1, None, "en", "s", 0), (1, None, "en", "s", 0), (None, "", None, None, None), (3, prose(rng, 3000), "en", "s", 1), (3, prose(rng, 3), "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (real.limit(0), odd.select(*real.columns)):
        docs = docs.withColumns({"row_key": F.lit(1), "component": F.lit("x"), "key": F.lit("y")})
        for _, stage in corpus_pipeline.STAGES[1:-1]:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert out.columns == docs.columns and out.count() <= docs.count()
    assert corpus_pipeline.language(spark, real.limit(0), "").count() == 0
    assert corpus_pipeline.packed(spark, real.limit(0), "").count() == 0


def test_pipeline_decisions(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs, counts = spark.read.parquet(f"{d}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.toPandas(), out.schema)
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True)
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    near = brute_near(texts)
    assert all(kept for *_, kept in near)
    bench = [tiling.tokens(r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert not any(f" {' '.join(b)} " in f" {' '.join(tiling.tokens(t))} " for b in bench for t in texts)
    packed = corpus_pipeline.packed(spark, docs, d)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op10_minhash_near_dedup"])
def test_query_equals_sql(spark, name):
    import duckdb

    from netloom.llm import queries

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    expected = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    found = queries.queries()[name](spark, "/root/testdata/sf0.001").select(*columns).collect()
    assert sorted(map(tuple, found)) == sorted(expected.fetchall())
