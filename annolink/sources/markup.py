"""Markup documents as node tables, one row per node in document order."""

from __future__ import annotations

from html.parser import HTMLParser
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.scan import Fold, scan
from ..operators.windows import layout_counters

# HTML elements that never have an end tag.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]


class _Nodes:
    """Collects the nodes of one document while a parser walks it."""

    def __init__(self):
        self.rows, self.stack, self.seen, self.closed = [], [], [{}], None

    def open(self, tag, namespace="", attributes=()):
        parent = self.stack[-1] if self.stack else None
        count = self.seen[-1]
        count[tag] = count.get(tag, 0) + 1
        base = parent["xpath"] if parent else ""
        row = {
            "node_id": len(self.rows), "parent_id": parent["node_id"] if parent else None, "depth": len(self.stack), "sibling_index": count[tag],
            "xpath": f"{base}/{tag}[{count[tag]}]", "tag": tag, "namespace": namespace, "attributes": list(dict(attributes).items()), "text": "", "tail": "", "child_ids": [],
        }
        if parent:
            parent["child_ids"].append(row["node_id"])
        self.rows.append(row)
        self.stack.append(row)
        self.seen.append({})
        self.closed = None

    def close(self):
        self.closed = self.stack.pop()
        self.seen.pop()

    def data(self, text):
        if self.closed is not None:
            self.closed["tail"] += text
        elif self.stack:
            self.stack[-1]["text"] += text

    def leaf(self, tag, text):
        self.open(tag)
        self.data(text)
        self.close()


def _xml(text) -> list[dict]:
    nodes, p = _Nodes(), expat.ParserCreate(namespace_separator="}")

    def split(name):
        return (name.rsplit("}", 1)[1], name.rsplit("}", 1)[0]) if "}" in name else (name, "")

    def refuse(*_):
        raise ValueError("entity declarations are refused")

    p.StartElementHandler = lambda n, a: nodes.open(*split(n), {split(k)[0]: v for k, v in a.items()})
    p.EndElementHandler = lambda _: nodes.close()
    p.CharacterDataHandler = nodes.data
    p.CommentHandler = lambda t: nodes.leaf("#comment", t)
    p.ProcessingInstructionHandler = lambda t, d: nodes.leaf("#processing-instruction", f"{t} {d}".strip())
    p.EntityDeclHandler = p.ExternalEntityRefHandler = refuse
    p.Parse(text if isinstance(text, bytes) else text.encode(), True)
    return nodes.rows


class _Html(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = _Nodes()

    def handle_starttag(self, tag, attrs):
        self.nodes.open(tag, "", {k: v or "" for k, v in attrs})
        if tag in VOID:
            self.nodes.close()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.nodes.close()

    def handle_endtag(self, tag):
        if any(r["tag"] == tag for r in self.nodes.stack):
            while self.nodes.stack[-1]["tag"] != tag:
                self.nodes.close()
            self.nodes.close()

    def handle_data(self, data):
        self.nodes.data(data)

    def handle_comment(self, data):
        self.nodes.leaf("#comment", data)

    def handle_pi(self, data):
        self.nodes.leaf("#processing-instruction", data)


def _html(text) -> list[dict]:
    h = _Html()
    h.feed(text if isinstance(text, str) else text.decode("utf-8", "replace"))
    h.close()
    return h.nodes.rows


# SRC-06 -----------------------------------------------------------------
def shred(docs: DataFrame, doc_id: str, content: str, kind: str = "xml") -> DataFrame:
    """Lossless node table of many documents; comments and instructions are nodes too.

    A document that cannot be read gives one #error node, so no document disappears. Rows
    leave the task in slices, whatever the size of a document.
    """
    walk = _xml if kind == "xml" else _html
    cols = ["doc_id", "node_id", "parent_id", "depth", "sibling_index", "xpath", "tag", "namespace", "attributes", "text", "tail", "child_ids"]

    def run(batches):
        for pdf in batches:
            for doc, text in zip(pdf["doc_id"], pdf["content"]):
                try:
                    rows = walk(text)
                except Exception as e:  # noqa: BLE001 - any unreadable document becomes a row
                    bad = _Nodes()
                    bad.leaf("#error", str(e))
                    rows = bad.rows
                for i in range(0, len(rows), 5000):
                    part = pd.DataFrame(rows[i:i + 5000])
                    part["doc_id"] = doc
                    part["parent_id"] = part["parent_id"].astype("Int64")
                    part["attributes"] = part["attributes"].map(dict)
                    yield part[cols]

    return docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(content).alias("content")).mapInPandas(run, S.NODE)


def shred_xml(spark, path) -> DataFrame:
    """Node table of XML files, the file name (without ending) as the document."""
    raw = spark.read.format("binaryFile").load(path)
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    return shred(raw.select(name.alias("doc_id"), "content"), "doc_id", "content")


# SRC-07 -----------------------------------------------------------------
def node_context(nodes: DataFrame, cell: int = 50_000) -> DataFrame:
    """Part, measure (index, number), page and system of every node, where it lies in a measure.

    Nodes are in preorder, so the part and measure of a node are the latest opened ones,
    provided that the node is deeper than them.
    """
    cells = [F.floor(F.col("node_id") / cell)]
    at = lambda k: F.try_element_at("attributes", F.lit(k))
    part = F.when((F.col("tag") == "part") & (F.col("depth") == 1), F.struct(at("id").alias("part_id"), F.col("node_id").alias("n"), F.col("depth").alias("d")))
    meas = F.when(F.col("tag") == "measure", F.struct(F.col("node_id").alias("n"), F.col("depth").alias("d"), at("number").alias("number")))
    d = scan(nodes, ["doc_id"], ["node_id"], [Fold("__part", "last", part), Fold("__meas", "last", meas)], cells)
    in_part = (F.col("depth") > F.col("__part.d")) | (F.col("node_id") == F.col("__part.n"))
    in_meas = (F.col("__meas.n") >= F.col("__part.n")) & ((F.col("depth") > F.col("__meas.d")) | (F.col("node_id") == F.col("__meas.n")))
    d = d.withColumns({"part_id": F.when(in_part, F.col("__part.part_id")), "measure_node": F.when(in_part & in_meas, F.col("__meas.n")), "measure_label": F.when(in_part & in_meas, F.col("__meas.number"))})
    d = d.drop("__part", "__meas")
    brk = d.where((F.col("tag") == "print") & F.col("measure_node").isNotNull()).groupBy("doc_id", "measure_node").agg(
        F.bool_or(F.coalesce(at("new-page") == "yes", F.lit(False))).alias("new_page"), F.bool_or(F.coalesce(at("new-system") == "yes", F.lit(False))).alias("new_system"))
    m = d.where("tag = 'measure' and measure_node = node_id").select("doc_id", "part_id", "measure_node", "measure_label").join(brk, ["doc_id", "measure_node"], "left")
    m = scan(m, ["doc_id", "part_id"], ["measure_node"], [Fold("measure_index", "count")], [F.floor(F.col("measure_node") / cell)])
    m = layout_counters(m, ["doc_id", "part_id"], ["measure_node"], cells=[F.floor(F.col("measure_node") / cell)])
    m = m.select("doc_id", "measure_node", F.col("measure_index").cast("int").alias("measure_index"), "page", "system")
    out = d.join(m, ["doc_id", "measure_node"], "left")
    return out.withColumn("measure_number", F.coalesce("measure_label", F.col("measure_index").cast("string"))).drop("measure_label")
