"""fusewright.functions"""
