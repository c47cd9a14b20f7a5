"""fusewright.sources"""
