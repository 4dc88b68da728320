"""Column constructors for outcomes, branch helpers and id arithmetic."""

from .outcomes import Outcomes, branch_values, ended, failed, joined, pending, resolved

__all__ = ["Outcomes", "branch_values", "ended", "failed", "joined", "pending", "resolved"]
