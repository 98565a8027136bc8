import pytest

pytest.importorskip("pointloom.llm")
