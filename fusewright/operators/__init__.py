"""fusewright.operators"""
