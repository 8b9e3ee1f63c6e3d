"""Models behind pluggable interfaces."""
