import random

import pytest

from larkspur.llm import mailtext, pagetext

NOW = "1998-02-05 00:00:00"


def mails(spark, bodies, subjects=None, senders=None):
    data = [(i, b, (subjects or {}).get(i), (senders or {}).get(i), f"1998-02-05 {i // 60:02}:{i % 60:02}:00", "x") for i, b in enumerate(bodies)]
    df = spark.createDataFrame(data, "mail_id int, body string, subject string, sender string, received_at string, thread string")
    return df.withColumn("received_at", df.received_at.cast("timestamp"))


def own(spark, bodies, subjects=None, senders=None):
    got = {}
    for r in mailtext.newly_written(mails(spark, bodies, subjects, senders), "mail_id", "body", "subject", "sender", "received_at").collect():
        got.setdefault(r["mail_id"], set()).add(r["line_no"])
    return got


def test_quotes_signatures_and_forwards(spark):
    bodies = [
        "Hello Ann,\n\nnew text here.\nThanks\nBob\n-- \nBob Smith\nTel. +00 1\n\nOn Mon, 2 Oct 1998 03:07, Ann wrote:\n> old text\n> more",
        "Ann Lee <a@b.example> wrote:\n| old text one\n| old text two\n\nMy answer.\n\n____________\nBob\nhttp://x.test/~b",
        "FYI\n\n----- Forwarded message -----\nFrom: A <a@b.example>\nDate: x\nTo: y\nSubject: z\n\nold body",
        "See below.\n\nFrom: A <a@b.example>\nSent: x\nTo: y\nSubject: z\n\nold body",
        "He wrote: never again.\nThanks, but the old plan was fine.\n-- this is only a dash --\nFrom: the depot To: the pier.",
        "<div>Hi there,</div>\n<div>&gt; quoted one</div>\r\n<div>&gt; quoted two</div>\n<p>text</p>",
        "Ann wrote:\n<blockquote>old one\nold two</blockquote>\n<p>new</p>\n<blockquote>old three</blockquote>\n<blockquote>old four</blockquote>",
        None, "", " \n \n", "ok", "Buy now!\n\nTo be removed from our mailings click http://x.test/out?id=1",
    ]
    assert own(spark, bodies) == {0: {1, 3}, 1: {5}, 2: {1}, 3: {1}, 4: {1, 2, 3, 4}, 5: {1, 4}, 6: {4}, 10: {1}, 11: {1}}


def test_inherited_passages_however_wrapped(spark):
    rng = random.Random(1)
    words = ["w" + str(rng.randint(0, 10**6)) for _ in range(60)]
    old = " ".join(words[:30])
    reply = "A new line of mine, which says " + " ".join(words[30:45]) + ".\n" + " ".join(words[5:15]) + "\n" + " ".join(words[15:28]) + "\nAnd one more new line."
    bodies = [old, reply, reply, old]
    got = own(spark, bodies, {0: "Plan", 1: "RE: plan", 2: "other", 3: "Fwd: Plan"})
    assert got == {0: {1}, 1: {1, 4}, 2: {1, 2, 3, 4}, 3: {1}}  # another thread inherits nothing, a copy keeps its text


def inherited(body, earlier):
    texts, automaton = [mailtext.Mail.of(x) for x in earlier], mailtext.SuffixAutomaton()
    for x in texts:
        automaton.add(x.words)
    return mailtext.inherited_lines(mailtext.Mail.of(body), automaton, texts)


def test_answers_to_unmarked_mails_of_any_share():
    rng = random.Random(4)
    words = ["w" + str(rng.randint(0, 10**6)) for _ in range(60)]
    told = [" ".join(words[i : i + 10]) for i in range(0, 60, 10)]
    old = "\n".join(["Hi all,", *told, "Ann"])
    between = "A new line of mine.\n" + " ".join(words[5:15]) + "\n" + " ".join(words[15:28]) + "\nAnd one more new line."
    assert inherited(between, [" ".join(words[:30])]) == [1, 2]
    assert inherited("Yes.\n\n" + old, [old]) == list(range(2, 10))
    assert inherited(old + "\n\nThat suits me well, come on Monday.", [old]) == list(range(8))
    long_quote = "\n".join("> " + x for x in told)
    other = " ".join("v" + str(i) for i in range(20))
    assert set(inherited("Mine.\n" + long_quote + "\n" + other, [old, other])) == {1, 2, 3, 4, 5, 6, 7}
    edited = old.replace("Hi", "Hello").replace(words[25], "x").replace("Ann", "Bea")
    assert inherited(edited, [old]) == [] and inherited(old + "\n-- \nTo unsubscribe write to x@y.test", [old]) == []
    assert inherited("Yes.\n\n" + old, [old, "Yes.\n\n" + old]) == list(range(2, 10))  # a copy of an answer


def test_answer_below_an_unmarked_mail(spark):
    rng = random.Random(5)
    old = "\n".join(" ".join("w" + str(rng.randint(0, 10**6)) for _ in range(10)) for _ in range(4))
    assert own(spark, [old, "Fine.\n\n" + old, old + "\n\nNo, not at all."], dict.fromkeys(range(3), "Plan")) == {0: {1, 2, 3, 4}, 1: {1}, 2: {6}}


def test_recurring_marks_and_sender_endings(spark):
    bodies = [f"text number {i}\n> {i} units would be too many\nend {i * 'x'}.\nour motto is {i}" for i in range(5)] + ["plain\n\n> a lonely quotation here\n\nend."]
    got = own(spark, bodies, senders=dict.fromkeys(range(5), "s@x"))
    assert got == {**{i: {1, 2, 3} for i in range(5)}, 5: {1, 5}}


def test_quotations_in_copies_and_hot_threads_are_no_recurring_marks(spark):
    told = " ".join(f"word{i}" for i in range(40))
    copy = f"{told}\n\n> the first quoted line here\n> the second quoted line here\n\n{told[::-1]}\n> one more quoted line\nend"
    bodies = [copy.replace(f"word{3 * i} ", "x ") for i in range(6)]  # edited copies of one mail
    assert own(spark, bodies) == {i: {1, 6, 8} for i in range(6)}
    rng = random.Random(6)
    bodies = [f"Answer {rng.random()} of mine.\n> shall we meet on the bridge\nNumber {i * 'y'} suits." for i in range(6)]
    assert own(spark, bodies, dict.fromkeys(range(6), "Plan")) == {i: {1, 3} for i in range(6)}
    edges = [f"Mine {rng.random()}.\n> some quoted line {i * 'z'}\n> which ends like this here\nWell {i * 'y'}." for i in range(6)]
    assert own(spark, edges) == {i: {1, 4} for i in range(6)}


def test_endings_of_copies_hot_senders_and_long_signatures(spark):
    rng = random.Random(7)

    def text():
        return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(25))

    copy = "\n".join(text() + "." for _ in range(5))
    assert own(spark, [copy, copy, copy.replace("a", "k", 2)], senders=dict.fromkeys(range(3), "s@x")) == {i: {1, 2, 3, 4, 5} for i in range(3)}
    hot = [text() + ".\n" + ("Please let me know." if i < 3 else text() + ".") for i in range(40)]
    df = spark.createDataFrame([(i, b, None, "s@x", None) for i, b in enumerate(hot)], "mail_id int, body string, subject string, sender string, received_at timestamp")
    assert mailtext.newly_written(df, "mail_id", "body", "subject", "sender", "received_at").count() == 80
    signature = "\n".join(f"the {x} line of my signature, always here." for x in "first second third fourth fifth sixth".split())
    assert own(spark, [text() + ".\n" + signature for _ in range(4)], senders=dict.fromkeys(range(4), "s@x")) == {i: {1} for i in range(4)}


def test_repeated_rows_count_once(spark):
    df = mails(spark, ["one\ntwo"])
    assert mailtext.newly_written(df.union(df), "mail_id", "body", "subject", "sender", "received_at").count() == 2
    assert mailtext.newly_written(df.limit(0), "mail_id", "body", "subject", "sender", "received_at").count() == 0


def test_suffix_automaton_against_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        texts = [[rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(rng.randint(1, 4))]
        automaton = mailtext.SuffixAutomaton()
        for t in texts:
            automaton.add(t)
        w, k = [rng.choice("abc") for _ in range(rng.randint(0, 9))], rng.randint(1, 4)
        want = [False] * len(w)
        for i in range(len(w)):
            for j in range(i + k, len(w) + 1):
                if any(w[i:j] == t[x : x + j - i] for t in texts for x in range(len(t))):
                    want[i:j] = [True] * (j - i)
        assert automaton.inherited(w, k) == want


def test_every_long_passage_has_a_sampled_run():
    rng = random.Random(3)
    for _ in range(50):
        shared = [str(rng.random()) for _ in range(mailtext.INHERITED_WORDS)]
        texts = [[str(rng.random()) for _ in range(rng.randint(0, 20))] + shared + [str(rng.random()) for _ in range(rng.randint(0, 20))] for _ in range(2)]
        run, text = mailtext.sampled_runs([texts[0], ["a"] * 5, [], texts[1]])
        assert set(text.tolist()) == {0, 3}
        both = set(run[text == 0].tolist()) & set(run[text == 3].tolist())
        alone = mailtext.sampled_runs([texts[1]])[0]
        assert both and set(alone.tolist()) == set(run[text == 3].tolist())  # a text's runs don't depend on its neighbours
        signed = {x - 2**64 if x >= 2**63 else x for x in both}
        found, whose = mailtext.passages_around([texts[0], [], texts[1]], [list(signed), [], list(signed)])
        passages = [set(found[whose == k].tolist()) for k in (0, 2)]
        assert passages[0] & passages[1] and passages[1] == set(mailtext.passages_around([texts[1]], [list(signed)])[0].tolist())


def thread(rng, n):
    """Mails of a thread that repeat passages of any earlier ones without a mark, wrapped anew; and the lines that are new."""
    def word():
        return "".join(rng.choices("abcdefghijkl", k=5))

    texts, bodies, want = [], [], {}
    common = [word() for _ in range(mailtext.SAMPLED_WORDS)]
    for i in range(n):
        lines = [[word() for _ in range(rng.randint(6, 11))] for _ in range(rng.randint(3, 5))]
        if rng.random() < 0.7:  # a run that many hold, inside passages that only some hold
            k = rng.randrange(len(lines))
            lines[k] = lines[k][:3] + common + lines[k][3:]
        mine = [w for x in lines for w in x]
        body, own = [" ".join(x) for x in lines], set(range(1, len(lines) + 1))
        for _ in range(rng.randint(0, 2) if i else 0):
            source = rng.choice(texts)
            size = rng.randint(16, 30)
            at = rng.randrange(max(1, len(source) - size))
            passage = source[at : at + size]
            for k in range(0, len(passage), 9):
                if len(passage[k : k + 9]) > 3:
                    body.append(" ".join(passage[k : k + 9]))
        texts.append(mine)
        bodies.append("\n".join(body))
        want[i] = own
    return bodies, want


@pytest.mark.parametrize("part_chars", [1_000_000, 300])
def test_passages_of_any_earlier_mail_of_a_thread(spark, part_chars, monkeypatch):
    monkeypatch.setattr(mailtext.inherited_in_threads, "__defaults__", (part_chars,))
    bodies, want = thread(random.Random(8), 60)
    shown = lambda got: {i: {n for n in x if n <= max(want[i])} for i, x in got.items()}
    got = own(spark, bodies, dict.fromkeys(range(60), "Re: Plan"))
    assert shown(got) == want
    assert sum(len(x) for x in got.values()) - sum(len(x) for x in want.values()) <= 2  # ends of passages may fall on other lines
    alone = own(spark, bodies)
    assert sum(len(x) for x in alone.values()) > sum(len(x) for x in want.values()) + 50  # without threads nothing is inherited


NAV = "".join(f'<li><a href="/{n}">{n}</a>' for n in ("Home", "News", "Help"))
LONG = "The council said on Monday that the bridge, closed since March, would open again in the"
SEASONS = "autumn winter spring summer thaw frost rain dry".split()


def page(title, body, layout="div"):
    boxes = {"div": ("<div class=nav><ul>{}</ul></div>", "<div class=c3>{}</div>", "<div class=foot><p>{}</p></div>"), "td": ("<table><tr><td><ul>{}</ul></td></tr>", "<tr><td>{}</td></tr>", "<tr><td>{}</td></tr></table>")}[layout]
    inner = "".join(body)
    return f"<html><head><title>{title} - Site</title></head><body>{boxes[0].format(NAV)}{boxes[1].format(f'<h1>{title}</h1>' + inner)}{boxes[2].format('Copyright Site. All rights reserved.')}</body></html>"


def lines_of(source):
    return "\n".join(b.text for b in pagetext.page_blocks(source))


def found(spark, pages):
    df = spark.createDataFrame(pages, "page_id bigint, url string, text string, html_source string, title string, site string")
    out = {}
    for r in pagetext.main_content(df, "page_id", "url", "text", "html_source", "title").collect():
        out.setdefault(r["page_id"], set()).add(r["line_no"])
    return out


def test_article_of_pages(spark):
    pages, want = [], {}
    for i, layout in enumerate(["div", "td"] * 4):
        body = ["<p>By Ann Lee</p>", f"<p>{LONG} {SEASONS[i]} too.</p>", f"<ul><li>item {SEASONS[i]}</ul>", "<p>Share: Link Mail</p>", f"<p>{LONG} {SEASONS[i]}.</p>"]
        source = page(f"Bridge of {SEASONS[i]} opens", body, layout)
        text = lines_of(source)
        pages.append((i, f"http://h{i % 2}.example/{i}", text, source, f"Bridge of {SEASONS[i]} opens - Site", "x"))
        want[i] = {n for n, line in enumerate(text.split("\n"), 1) if line.startswith(("Bridge", LONG[:20], "item"))}
    pages += [(20, None, None, "<p>x", None, "x"), (21, "http://h0.example/z", "", None, None, "x"), (22, "http://h0.example/y", "Home\nNews\n404 - not here", "<ul>" + NAV, None, "x")]
    pages.append(pages[0])
    cut_off = (23, "http://h0.example/c", pages[2][2], pages[2][3][:120], pages[2][4], "x")
    no_source = (24, "http://h0.example/d", pages[4][2], None, pages[4][4], "x")
    got = found(spark, [*pages, cut_off, no_source])
    assert {i: got.get(i) for i in want} == want
    assert got[24] == want[4] and got[23] == want[2] and not {20, 21, 22} & set(got)


def test_copies_of_an_article_are_no_furniture(spark):
    pages, want = [], {}
    for i in range(12):
        k = 0 if i < 6 else i  # six addresses of one article, on two hosts
        title = f"Bridge {'abcdefghijkl'[k] * 4} opens"
        body = [f"<p>{LONG} {w} of {'abcdefghijkl'[k] * 5}.</p>" for w in SEASONS[:4]]
        source = page(title, body)
        text = lines_of(source)
        pages.append((i, f"http://h{i % 2}.example/{i}", text, source, title + " - Site", "x"))
        want[i] = {n for n, line in enumerate(text.split("\n"), 1) if line.startswith(("Bridge", LONG[:20]))}
    assert found(spark, pages) == want


def test_blocks_of_broken_markup():
    texts = [b.text for b in pagetext.page_blocks("<ul><li>a<li><b>b</b> c</ul><!-- x --><script>1<2</script>d<br>e &amp; f<p>g<p>h <a href='x'>link</a><unknown>i</p><div")]
    assert texts[:5] == ["a", "b c", "d", "e & f", "g"] and "link" in " ".join(texts)
    assert pagetext.page_blocks("") == [] and pagetext.page_blocks("plain")[0].text == "plain" and pagetext.page_blocks("<!-- open") == []
