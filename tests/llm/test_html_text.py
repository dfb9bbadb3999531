import random

from noteloom.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style><script>var t="</p>";</script><body>
<header><a href=/>Site</a></header><nav><ul><li>Home<li>About</ul></nav><div class="cookie-notice">We use cookies</div>
<{tag}><h1>Title &amp; {n}</h1><p><b>First  para<br>{n} goes on<p>Second &lt;{n}&gt;<ul><li>one</li><li>two</ul>
<div class="xk1">Read our blog every day</div><aside>side</aside><p>Last {n}.</p></{tag}>
<section id="comments"><p>nice post</p></section><footer>&copy; me</footer></body></html>"""


def test_main_text():
    want = "Title & 7\nFirst para 7 goes on\nSecond <7>\none\ntwo\nRead our blog every day\nLast 7."
    assert H.main_text(PAGE.format(tag="article", n=7), None) == want
    parts = "<article><p>part one of it all</article><article><p>part two of it all</article>"
    assert H.main_text(f"<body><div>{parts}</div><nav>x</nav>", None) == "part one of it all\npart two of it all"
    assert H.main_text("", None) == "" and H.main_text("<p>a<td>b <", None) == "a\nb <"
    assert H.main_text("<article><p>" + "word " * 100_000 + "</article>", None).count("word") == 100_000


def brute_match(a, b):
    """The size of the best matching of two trees (key, children), by recursion over all pairs."""
    if a[0] != b[0]:
        return 0
    x, y = a[1], b[1]
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            t[i + 1][j + 1] = max(t[i][j + 1], t[i + 1][j], t[i][j] + brute_match(x[i], y[j]))
    return t[-1][-1] + 1


def test_matching_is_the_best():
    rng = random.Random(2)

    def tree(depth):
        return (rng.choice("abc"), [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else [])

    def flat(t):
        keys, kids = [], []

        def add(n):
            me = len(keys)
            keys.append(n[0])
            kids.append([])
            for c in n[1]:
                kids[me].append(add(c))
            return me

        add(t)
        return keys, kids

    for _ in range(200):
        a, b = tree(3), tree(3)
        got = H.match(flat(a), flat(b))
        assert len(got) == brute_match(a, b)


def test_wrapper_takes_what_varies(spark):
    pages = [(i, "http://h.example/x", PAGE.format(tag="div class=q", n=str(i) * 40), "clash") for i in range(12)] + [(None, None, None, None), (50, "http://one.example/", PAGE.format(tag="div", n=3), "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in H.extracted(df).collect()}
    assert len(got) == 14 and got[None].text == "" and got[None].n_chars == 0
    n = "7" * 40
    want = f"Title & {n}\nFirst para {n} goes on\nSecond <{n}>\nLast {n}."
    assert got[7].text == want and got[7].n_chars == len(want)  # the list and the advert are the same on all pages
    assert "Title & 3" in got[50].text and "cookies" not in got[50].text
    assert H.extracted(df.limit(0)).count() == 0


def site(rng, host, pages, names, wide):
    """Pages of one template without marks or known names: menus, teasers, constant lines, and the text between them."""
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))
    x, head = rng.sample(names, 6), words(4)
    out = []
    for k in range(pages):
        blocks = [words(rng.randint(8, 40)) for _ in range(rng.randint(2, 6) * wide)]
        menu = "".join(f"<a href=/{w}>{w}</a> " for w in words(6).split())
        links = "".join(f"<li><a href=#>{words(3)}</a>" for _ in range(4))
        inner = "".join(f"<p>{b}</p>" if j % 2 else f"<div class={x[5]}>{b}</div>" for j, b in enumerate(blocks))
        title = words(5)
        page = f"<html><body><div class={x[0]}>{head}</div><div class={x[1]}>{menu}</div><div class={x[2]}><h1>{title}</h1>{inner}<p>Read {head} daily</p><ul>{links}</ul></div><div class={x[3]}>{words(6)}</div><div class={x[4]}>&copy; {head}</div></body></html>"
        out.append((f"http://{host}/{k}", page, "\n".join([title, *blocks])))
    return out


def test_unknown_names_without_marks(spark):
    """Extraction equals the planted text where only the alignment can tell what is content; without it, it does not."""
    rng = random.Random(9)
    names = [f"x{a}{b}" for a in "abcdefgh" for b in "qwxyz"]
    pages = [p for s in range(6) for p in site(rng, f"s{s}.example", 8, names, 1 + s)]
    pages += [(f"http://t{k}.example/", *p[1:]) for k, p in enumerate(site(rng, "pool", 8, names, 2))]  # hosts of one page, one template
    pages.append(pages[0])  # a repeated row
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extracted(df).collect()}
    assert len(got) == len(pages)
    assert [got[i] for i in range(len(pages))] == [t for _, _, t in pages]
    assert sum(H.main_text(h, None) == t for _, h, t in pages) == 0


def test_marks_are_evidence_only():
    """The same pages with article tags: with marks and lists off, alignment alone finds what they mark."""
    rng = random.Random(4)
    pages = [PAGE.format(tag="article", n="".join(rng.choices("abcdefg ", k=300))).replace("<li>one<li>two", "").replace("every day", f"every {k} day") for k in range(9)]
    reference = H.load(H.skeleton(pages[0]))
    sums = {}
    for p in pages[1:]:
        for i, h, *own in H.compared(p, reference):
            t = sums.setdefault((i, h), [0, 0, 0, 0, 0])
            for k, x in enumerate([1, *own]):
                t[k] += x
    off, on = (H.wrapper(reference, sorted((*k, *v) for k, v in sums.items()), e) for e in (False, True))
    assert on["keys"][on["root"]] == off["keys"][off["root"]] == "article"
    for p in pages[1:]:
        assert H.main_text(p, on) == H.main_text(p, off, False)


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


def heavy(rng, host, pages, paragraphs, kind):
    """Pages of which most is template, without marks or known names: twelve constant blocks around and between the text.
    kind: `blocks`, `lists` (the constant blocks are lists) or `links` (with a line of links in each)."""
    fixed = [words(rng, 40) for _ in range(12)]
    dress = {
        "blocks": lambda b: f"<div class=k{b[:3]}><p>{b}</p></div>",
        "lists": lambda b: "<ul class=k>" + "".join(f"<li>{x}" for x in b.split()) + "</ul>",
        "links": lambda b: f"<div class=k><p>{b}</p><a href=#>{b[:9]}</a></div>",
    }[kind]
    out = []
    for k in range(pages):
        title, text = words(rng, 5), [words(rng, 30) for _ in range(paragraphs)]
        inner = "".join(f"<p>{p}</p>" + (dress(fixed[4 + j]) if j < 3 else "") for j, p in enumerate(text))
        shown = 4 + min(3, paragraphs)
        body = "".join(map(dress, fixed[:4])) + f"<div class=m><h1>{title}</h1>{inner}</div>" + "".join(map(dress, fixed[shown:]))
        out.append((f"http://{host}/{k}", f"<html><body>{body}</body></html>", "\n".join([title, *text])))
    return out


def test_hosts_that_are_mostly_template(spark):
    """Short articles under a heavy template are right on all pages, however little of a page varies."""
    rng = random.Random(21)
    pages = [p for kind in ("blocks", "lists", "links") for n in (1, 2, 6, 12, 20) for p in heavy(rng, f"{kind}{n}.example", 20, n, kind)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extracted(df).collect()}
    wrong = [pages[i][0] for i in range(len(pages)) if got[i] != pages[i][2]]
    assert not wrong, wrong


def test_copies_do_not_make_content_template(spark):
    """A host where most pages are copies of one page, exactly or but for a word."""
    rng = random.Random(5)
    own = heavy(rng, "copies.example", 12, 4, "blocks")
    url, page, text = own[0]
    word = text.split()[-1]
    pages = own + [(f"{url}?{k}", page, text) for k in range(100)] + [(f"{url}&{k}", page.replace(f" {word}<", f" {word}{k}<"), f"{text}{k}") for k in range(100)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extracted(df).collect()}
    assert [got[i] for i in range(len(pages))] == [t for *_, t in pages]
