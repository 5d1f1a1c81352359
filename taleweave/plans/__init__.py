"""Registered queries: each module pairs a DataFrame plan with its reference SQL."""
