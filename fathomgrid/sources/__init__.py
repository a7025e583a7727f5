"""fathomgrid.sources"""
