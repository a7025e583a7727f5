"""fathomgrid.streaming"""
