"""fathomgrid.plans"""
