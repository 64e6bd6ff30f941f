"""repoloom: prepare source-code repositories as data with PySpark.

Tables of repository files go in; inventories, decoded text, function spans,
outlines, code segments and merged Markdown documents come out, for every
(repo, branch) in one distributed job.
"""

from repoloom.session import build_session

__all__ = ["build_session"]
