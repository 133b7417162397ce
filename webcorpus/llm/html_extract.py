"""Main text of pages: text blocks classified by a decision tree.

The tree is trained by Spark on the blocks of a few labelled pages and goes to
the tasks as nested tuples; a page is a row from start to end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webcorpus.llm.common import pick, tuned
from webcorpus.llm.html_blocks import features, text_blocks
from webcorpus.llm.html_examples import PAGES

#: A leaf (main or not), or (feature, threshold, tree if not above, tree if above).
Tree = bool | tuple[int, float, "Tree", "Tree"]


def labelled_blocks(pages: tuple[str, ...] = PAGES) -> list[tuple[float, tuple[float, ...]]]:
    """The small labelled table: (1.0 if main, features) of every block of the labelled pages."""
    return [
        (float(block.label), row)
        for blocks in map(text_blocks, pages)
        for block, row in zip(blocks, features(blocks))
    ]


def train_tree(spark: SparkSession, pages: tuple[str, ...] = PAGES, depth: int = 6) -> Tree:
    """Fit the decision tree on the labelled pages."""
    rows = [(label, Vectors.dense(row)) for label, row in labelled_blocks(pages)]
    table = spark.createDataFrame(rows, ["label", "features"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, seed=1).fit(table)

    def plain(node) -> Tree:
        if node.subtreeDepth() == 0:
            return node.prediction() > 0.5
        split = node.split()
        return split.featureIndex(), split.threshold(), plain(node.leftChild()), plain(node.rightChild())

    return plain(model._java_obj.rootNode())


def is_main(tree: Tree, row: tuple[float, ...]) -> bool:
    """The decision of the tree for one block."""
    while not isinstance(tree, bool):
        feature, threshold, low, high = tree
        tree = low if row[feature] <= threshold else high
    return tree


def main_text(tree: Tree, html: str | None) -> str:
    """The main blocks of a page in page order, joined by line ends; empty for null."""
    blocks = text_blocks(html) if html else []
    return "\n".join(b.text for b, row in zip(blocks, features(blocks)) if is_main(tree, row))


def extract_main_text(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """Rows (page_id, url, text, n_chars) of all pages; ``n_chars`` counts code points.

    Null, empty and textless pages give an empty text. Repeated rows and null ids
    and urls are kept; other columns are ignored; no rows give no rows.
    """
    spark = tuned(pages.sparkSession)
    tree = train_tree(spark) if tree is None else tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(tree, html.as_py()) for html in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    wanted = pick(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    return wanted.mapInArrow(run, "page_id long, url string, text string, n_chars long")
