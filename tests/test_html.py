"""The scanner against the standard library's parser, fed row by row."""

import random
import time
from html.parser import HTMLParser

import pytest

from filingflow.functions.html import text_outside_markup


class Collector(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.texts, self.dropped = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript"):
            self.dropped.append(tag)

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag in self.dropped:
            self.dropped.remove(tag)

    def handle_data(self, data):
        if not self.dropped:
            self.texts.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")


def by_library(page):
    c = Collector()
    c.feed(page)
    c.close()
    return " ".join("".join(f" {t} " for t in c.texts).split())


PIECES = ['<p title="a > b">', "<a href='x>y'>", "</a>", '<img alt="it\'s > that" src=x/y>', "<b>", "</b >", "<br/>", "<!-- > <p> -->", "<!DOCTYPE html>", "<?xml x?>",
          "<script>a < b > c</script>", "<SCRIPT type='x>'>'</p>' \"</SCRIPT>", "<style>p > b { }</style>", '<noscript><img alt="</noscript>">no</noscript>', "<noscript>a<b>c</b></noscript>",
          "words", " and text ", "é 漢", "1 < 2", " > ", '"quoted"', "it's", "\n", "<input value = \"x>\" checked>", "<td class=a'b>", "<script/>"]


def test_equals_the_library_on_random_pages():
    rng = random.Random(8)
    for _ in range(3000):
        page = "".join(rng.choices(PIECES, k=rng.randrange(12)))
        assert " ".join(text_outside_markup(page).split()) == by_library(page), page


@pytest.mark.parametrize("page, text", [
    ("", ""), ("no markup", "no markup"), ("a < b", "a < b"), ("x <p", "x <p"), ("x <p title=\"y > z", "x z"), ("<p a='>b</p>c", "b c"), ("<script>x", ""), ("a<noscript>b<p>c</p>", "a"),
    ("a<!-- b > c", "a c"), ("<noscript>a<noscript>b</noscript>c</noscript>d", "d"), ("</noscript>a", "a"), ("<scripted>a</scripted>", "a"), ("<style>a</styles>b</style>c", "c"), ("İ<script>x</script>y", "İ y"), ("<", "<"), ("a<>b", "a<>b"),
])
def test_defined_results(page, text):
    assert " ".join(text_outside_markup(page).split()) == text


@pytest.mark.parametrize("piece", ["<a '", "<a x='", "<a x='>", "<a x=\"' ", "<!--", "<!-- >", "</", "<script", "<script>", "<noscript>", "<p =", "=", "</scrip"])
def test_hostile_pages_take_linear_time(piece):
    def seconds(n):
        t = time.perf_counter()
        text_outside_markup(piece * n + ">")
        return time.perf_counter() - t

    seconds(1000)
    assert seconds(160_000) < 0.5 + 40 * seconds(8000)
