"""Main text where article tags mark something else than the page's body, or only a part of it."""

from tessera.llm import htmltext

BODY = [f"{'the body of this page goes on and on ' * 8}{i}" for i in range(6)]


def test_teaser_cards_do_not_hide_the_body():
    cards = "".join(f"<article><a href='{i}'>Card</a> <a href='{i}'>more</a></article>" for i in range(4))
    page = f"<body><div>{''.join(f'<p>{x}</p>' for x in BODY)}</div><div>{cards}</div></body>"
    assert htmltext.main_text(page) == " ".join(BODY)


def test_a_quoted_post_does_not_hide_the_body():
    post = "a post that the page quotes at length " * 6
    page = f"<body><div>{''.join(f'<p>{x}</p>' for x in BODY[:3])}<article><p>{post}</p></article>{''.join(f'<p>{x}</p>' for x in BODY[3:])}</div></body>"
    assert htmltext.main_text(page) == " ".join([*BODY[:3], post.strip(), *BODY[3:]])


def test_a_chosen_article_is_whole():
    page = f"<body><div><a>x</a> <a>y</a></div><article><h1>Head</h1><div>{''.join(f'<p>{x}</p>' for x in BODY)}</div><p>End.</p></article></body>"
    assert htmltext.main_text(page) == " ".join(["Head", *BODY, "End."])


def test_main_keeps_its_first_and_last_lines():
    page = f"<body><div><a>x</a> <a>y</a></div><main><h1>Head</h1>{''.join(f'<p>{x}</p>' for x in BODY)}<p>End.</p></main></body>"
    assert htmltext.main_text(page) == " ".join(["Head", *BODY, "End."])
