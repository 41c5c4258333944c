import pytest

pytest.importorskip("concordat.llm")
