"""Columns of the catalogue and of its companions, and their names in source files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The catalogue's columns, all text and never null.
CATALOGUE = ["id", "link", "file_name", "title", "tags", "author", "team", "language", "pages", "upload_date"]
#: Header of source files, in the same order.
SOURCE_HEADER = ["ID", "链接", "文件名", "标题", "标签", "作者", "团队", "语言", "页数", "上传日期"]
#: Columns of scored rows, in order.
SCORED = ["score", "id", "link", "upload_date", "title", "author", "team", "tags", "language", "pages", "local_path", "file_name", "parsed_tags", "title_words", "search_text"]
#: Stands for an item without a local folder.
NO_FOLDER = "no local folder"
HISTORY = (
    "opened_at string, action string, id string, title string, author string, link string, local_path string, "
    "tags array<string>, title_words array<string>"
)


def rename_source(df: DataFrame) -> DataFrame:
    """Source headers to library names; other columns keep theirs."""
    names = dict(zip(SOURCE_HEADER, CATALOGUE, strict=True))
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])
