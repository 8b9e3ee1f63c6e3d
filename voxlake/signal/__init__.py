"""Waveform kernels."""
