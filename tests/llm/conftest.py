import os
import sys

sys.path.insert(0, os.path.dirname(__file__))

from conftest_llm import docs, empty, texts  # noqa: E402, F401
