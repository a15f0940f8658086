import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from pageloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def pages(spark):
    def make(*htmls, title="Given"):
        rows = [(i, title, html) for i, html in enumerate(htmls)]
        return spark.createDataFrame(rows, "page_id bigint, title string, html string")

    return make


def wiki(body: str, heading: str = "Head") -> str:
    return (
        f'<html><body><h1 id="firstHeading">{heading}</h1><div id="mw-content-text">'
        f'<div class="mw-parser-output">{body}</div></div></body></html>'
    )
