"""concordat.sources"""
