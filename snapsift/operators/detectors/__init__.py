"""Outlier detectors: records in, one score per record out, larger = more anomalous."""
