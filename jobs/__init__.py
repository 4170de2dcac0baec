"""Runnable jobs: each has a function that takes a session, a command line, and settings in a JSON file of its name."""

from __future__ import annotations

from jobs import alignment_report, corpus_windows

QUERIES = {"job1_corpus_windows": corpus_windows.job1_corpus_windows, "job2_alignment_report": alignment_report.job2_alignment_report}
SQL = {"job1_corpus_windows": corpus_windows.SQL, "job2_alignment_report": alignment_report.SQL}
