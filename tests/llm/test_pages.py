"""What articles may hold and where they may stand, and archives that end too early."""

import random
import time
import zlib

import pytest

from tests.llm.data import prose
from tickloom.llm import warc, wrapper


def extracted(spark, pages):
    df = spark.createDataFrame([(k, "https://host.example/p", page) for k, page in enumerate(pages)], "page_id bigint, url string, html string")
    return {r["page_id"]: r["text"] for r in wrapper.extract(df).collect()}


def test_link_lists_inside_the_article_stay(spark):
    rng = random.Random(3)
    pages, want = [], []
    for _ in range(8):
        body, names = prose(rng, 40), [prose(rng, 2) for _ in range(6)]
        links = "".join(f"<li><a href='/x'>{x}</a></li>" for x in names)
        pages.append(f"<body><nav><ul><li><a>home</a></li><li><a>news</a></li><li><a>more</a></li></ul></nav><article><p>{body}</p><ul>{links}</ul></article></body>")
        want.append(" ".join([body, *names]))
    assert extracted(spark, pages) == dict(enumerate(want))


def test_prose_beside_the_body_stays_and_labelled_boxes_go(spark):
    rng = random.Random(4)
    pages, want = [], []
    for _ in range(10):
        lead, body, advert, end = prose(rng, 6), prose(rng, 150), prose(rng, 6), prose(rng, 4)
        pages.append(f"<body><div><div>{lead}</div><div><p>{body}</p></div><div>{end}</div></div><div>Sponsored: {advert}</div></body>")
        want.append(f"{lead} {body} {end}")
    assert extracted(spark, pages) == dict(enumerate(want))


def test_a_form_that_holds_the_page_is_no_form_to_drop(spark):
    rng = random.Random(5)
    pages, want = [], []
    for k in range(8):
        body = prose(rng, 40)
        inner = f"<main><p>{body}</p></main>" if k % 2 else f"<div><p>{body}</p></div>"
        pages.append(f"<body><form id='aspnetForm' action='/x'><input name='a'><div>{inner}<form class='search'><label>Find</label><button>Go</button></form></div></form></body>")
        want.append(body)
    assert extracted(spark, pages) == dict(enumerate(want))
    assert wrapper.content(wrapper.parse(f"<body><p>{want[0]}</p><form><p>Write to us</p></form></body>")) == want[0]


def test_judging_takes_time_in_proportion_to_depth():
    took = []
    for depth in (10_000, 40_000):
        root = wrapper.parse("<body>" + "<div>" * depth + "<p>some words</p>" + "</div>" * depth + "</body>")
        counts = {k: (5, 5, 1, 0, 60, 5) for k in range(depth + 4)}
        began = time.perf_counter()
        wrapper.judge(root, counts)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * max(took[0], 0.1)


@pytest.mark.parametrize("cut", range(1, 13))
def test_archives_that_are_cut_off_are_refused(tmp_path, cut):
    records = b"".join(warc.record(k, "http://h/", b"payload %d" % k, f"{k}", None, False) for k in range(3))
    whole = zlib.compress(records, wbits=31)
    source = tmp_path / "a.whole.warc.gz"
    source.write_bytes(whole[:-cut])
    with pytest.raises(ValueError, match="cut short"):
        warc.normalise_file(str(source), str(tmp_path / "b.warc.gz"))
    source.write_bytes(whole + whole + b"\0" * 512)
    assert warc.normalise_file(str(source), str(tmp_path / "c.warc.gz")) == 6
