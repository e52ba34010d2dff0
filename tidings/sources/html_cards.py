"""Message cards of a public preview page. Each page is read into a small tree, in Arrow batches; cards are projections of it."""

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from html.parser import HTMLParser

from pyspark.sql import DataFrame

# Classes of the preview's markup.
CARD, TEXT, PHOTO = "tgme_widget_message", "tgme_widget_message_text", "tgme_widget_message_photo_wrap"
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


@dataclass
class Node:
    tag: str
    attrs: dict
    children: list = field(default_factory=list)

    def walk(self) -> Iterator["Node"]:
        """The nodes below, in document order, without recursion."""
        todo = [iter(self.children)]
        while todo:
            child = next(todo[-1], None)
            if child is None:
                todo.pop()
            elif isinstance(child, Node):
                yield child
                todo.append(iter(child.children))

    def strings(self) -> Iterator[str]:
        """The texts below, those of scripts and styles left out."""
        todo = [iter(self.children)]
        while todo:
            child = next(todo[-1], None)
            if child is None:
                todo.pop()
            elif isinstance(child, str):
                yield child
            elif child.tag not in ("script", "style"):
                todo.append(iter(child.children))

    def all(self, name: str) -> list["Node"]:
        return [n for n in self.walk() if name in (n.attrs.get("class") or "").split()]


class _Tree(HTMLParser):
    """An end tag closes the last open element of its name with all inside it; one without such an element does nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [Node("", {})]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, dict(attrs)))

    def handle_endtag(self, tag):
        if any(n.tag == tag for n in self.open):
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    p = _Tree()
    p.feed(html)
    p.close()
    return p.open[0]


def style_address(style: str | None) -> str | None:
    """The first address that a style attribute's declarations name, null if none."""
    for declaration in (style or "").split("url(")[1:]:
        address = declaration.partition(")")[0].strip().strip("'\"")
        if address:
            return address
    return None


def _moment(text: str | None) -> datetime | None:
    try:
        at = datetime.fromisoformat((text or "").replace("Z", "+00:00"))
    except ValueError:
        return None
    return at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at


def parse(html: str | None, base: str | None = None) -> list[dict]:
    """Cards with a number and a time, newest number first; others are dropped. The text is that of the first text node, its pieces by line; a time without a zone is UTC; the link is base/number."""
    out = []
    for card in tree(html or "").all(CARD):
        number = (card.attrs.get("data-post") or "").rpartition("/")[2].strip()
        at = next((_moment(n.attrs.get("datetime")) for n in card.walk() if n.tag == "time"), None)
        if at is None or not number.removeprefix("-").isdecimal():
            continue
        text = next(iter(card.all(TEXT)), Node("", {}))
        addresses = [style_address(n.attrs.get("style")) for n in card.all(PHOTO)]
        out.append({
            "message_id": int(number), "message_datetime": at, "text": "\n".join(s.strip() for s in text.strings() if s.strip()),
            "link": f"{base}/{int(number)}" if base else None, "image_urls": [a for a in addresses if a],
        })
    return sorted(out, key=lambda c: -c["message_id"])


def cards(pages: DataFrame, key: str, html: str, base: str | None = None) -> DataFrame:
    """(key, message_id, message_datetime, text, link, image_urls) of every card of every page."""
    import pandas as pd

    columns = [key, "message_id", "message_datetime", "text", "link", "image_urls"]

    def run(batches):
        for pdf in batches:
            rows = [{key: k, **c} for k, h in zip(pdf[key], pdf[html], strict=True) for c in parse(h, base)]
            yield pd.DataFrame(rows, columns=columns)

    kind = dict(pages.dtypes)[key]
    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, message_id long, message_datetime timestamp_ntz, text string, link string, image_urls array<string>")
