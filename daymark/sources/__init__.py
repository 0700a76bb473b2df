"""Readers: five log formats, result logs, caches, and the adapters of the analytic test tables."""
