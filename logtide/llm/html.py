"""Main text of web pages by two-pass block rules.

Pass one classifies each block by itself from stop-word density, length, link density and the elements around it: dense
blocks, and long ones of middling density, are text; long sparse ones outside an article are not; the others are
undecided. Pass two gives undecided blocks, none of them long, the label of the nearest decided blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by role, names of page furniture, common words of four languages.
BLOCKS = set("address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()) - {"br"}
HIDDEN = set("script style noscript template head title iframe object svg select option button textarea".split())
FURNITURE = set("nav footer aside form header menu dialog".split())
NAMES = set("ad ads advert advertisement banner breadcrumb comment comments cookie disclaimer footer header menu nav navbar newsletter notice popup promo related share sidebar social sponsor widget".split())
BESIDE = set("with without has no is not after before".split())
STOP = set("the of and to in a is that for it was on are with by this be as at from or an le la de les des et un une du en que qui dans est pour par sur au pas der die und das den von zu mit sich ein eine ist im dem nicht auf el los y las se por con su para al lo como".split())
#: All that can be in a head; any other element ends an open one, as its end tag is optional.
IN_HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
SHORT, LONG, LINKS, DENSE, THIN = 70, 200, 0.5, 0.2, 0.1


def _names(tokens: str) -> set[str]:
    """Words of an element's names; a name like ``with-sidebar`` says what stands beside the element, not what it is."""
    parts = [t.replace("_", "-").split("-") for t in tokens.lower().split()]
    return {w for p in parts if p[0] not in BESIDE for w in p}


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool]] = []
        self.blocks: list[dict] = []
        self.text: list[str] = []
        self.linked = 0

    def cut(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            last = max((k for k, (_, _, m) in enumerate(self.stack) if m), default=-1)
            inside = any(b for _, b, _ in self.stack[last + 1 :])
            self.blocks.append({"text": text, "links": self.linked / len(text), "bad": any(b for _, b, _ in self.stack), "inside": inside, "main": last >= 0})
        self.text, self.linked = [], 0

    def end_head(self, tag: str | None) -> None:
        """Ends an open head before ``tag`` or, if that is None, before text; only body ends its hidden elements too."""
        at = next((k for k, (t, _, _) in enumerate(self.stack) if t == "head"), None)
        if at is not None and tag not in IN_HEAD and (tag == "body" or not any(t in HIDDEN for t, _, _ in self.stack[at + 1 :])):
            del self.stack[at:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.cut()
        self.end_head(tag)
        if tag == "br":
            self.text.append(" ")
        if tag == "p":  # an open paragraph, with the inline elements in it, ends here
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == "p":
                    del self.stack[k:]
                    break
                if self.stack[k][0] in BLOCKS:
                    break
        if tag not in VOID:
            names = _names(" ".join(v or "" for k, v in attrs if k in ("class", "id", "role")))
            main = tag in ("article", "main")
            self.stack.append((tag, (tag in FURNITURE and not (tag == "header" and any(m for _, _, m in self.stack))) or (not main and tag != "body" and bool(NAMES & names)), main))

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.cut()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break

    def handle_data(self, data):
        if not data.isspace():
            self.end_head(None)
        if any(t in HIDDEN for t, _, _ in self.stack):
            return
        self.text.append(data)
        if any(t == "a" for t, _, _ in self.stack):
            self.linked += len(" ".join(data.split()))


def _decided(blocks: list[dict], labels: list[bool | None]) -> list[bool | None]:
    """For each block, the label of the decided block nearest before it with the same place, in or out of the article."""
    seen: dict[bool, bool] = {}
    out = []
    for b, label in zip(blocks, labels):
        out.append(seen.get(b["main"]))
        if label is not None and not b["bad"]:
            seen[b["main"]] = label
    return out


def extract(html: str | None) -> str:
    """Main text of one page: kept blocks in page order, joined by a line feed."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.cut()
    blocks = parser.blocks
    if any(b["main"] for b in blocks) and not any(b["main"] and not b["bad"] for b in blocks):
        for b in blocks:  # names around the only article say nothing about it
            b["bad"] = b["inside"] or not b["main"]
    within = any(b["main"] for b in blocks)
    labels: list[bool | None] = []
    for b in blocks:
        words = b["text"].lower().split()
        dense = sum(w.strip(".,;:!?") in STOP for w in words) / len(words)
        size = len(b["text"])
        if b["bad"] or (b["links"] > LINKS and not b["main"]) or (within and not b["main"]):
            labels.append(False)
        elif size < SHORT or b["links"] > LINKS:  # in an article links alone decide nothing
            labels.append(None)
        elif dense >= DENSE or (size >= LONG and (dense >= THIN or b["main"])):
            labels.append(True)
        elif dense >= THIN or size < LONG:
            labels.append(None)
        else:
            labels.append(False)
    last, following = _decided(blocks, labels), _decided(blocks[::-1], labels[::-1])[::-1]
    kept = []
    for k, label in enumerate(labels):
        if label is None:
            before, after = last[k], following[k]
            label = before or after or (before is None and after is None and blocks[k]["main"])
        if label:
            kept.append(blocks[k]["text"])
    return "\n".join(kept)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id_col, url_col, text, n_chars)``, one row for each input row.

    Null or empty pages give an empty text; null ids and addresses and repeated rows stay; very long pages are read
    whole; an empty table gives an empty table; other columns are not read and may have any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([extract(x.as_py()) for x in batch.column(2)], pa.string())], ["id", "url", "text"])

    chosen = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = chosen.mapInArrow(run, f"id {dict(chosen.dtypes)['id']}, url string, text string")
    return rows.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
