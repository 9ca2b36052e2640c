"""The texts of the fixtures, for tests that build on them."""

import importlib.util
import os

_spec = importlib.util.spec_from_file_location("llm_fixtures", os.path.join(os.path.dirname(__file__), "conftest.py"))
_fixtures = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_fixtures)
PASSAGE, TEXTS, prose = _fixtures.PASSAGE, _fixtures.TEXTS, _fixtures.prose
