"""Interval, sequence and statistics operators for keyed coordinate data, as DataFrame functions."""
