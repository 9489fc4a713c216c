"""Text triage on Spark: profile, classify, retrieve, refine and route case texts."""
