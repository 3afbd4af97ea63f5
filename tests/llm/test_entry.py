"""The entry file with the subpackage in place, absent or broken."""

import pytest


def test_entry_fails_on_a_broken_subpackage(monkeypatch):
    """Only the absence of the subpackage is forgiven, not an import that fails inside it."""
    import importlib
    import sys

    import __spark_entry__ as e

    for m in [m for m in sys.modules if m.startswith("tripleloom.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "tripleloom.llm.textkit", None)
    with pytest.raises(ImportError):
        importlib.reload(e)
    monkeypatch.undo()
    importlib.reload(e)
