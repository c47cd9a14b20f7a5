"""fusewright.plans"""
