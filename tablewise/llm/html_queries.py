"""Query of the HTML extraction."""

from tablewise.llm import html
from tablewise.llm.common import table
from tablewise.llm.registry import query


@query("op8_html_main_text")
def op8(spark, sf_dir):
    return html.extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
